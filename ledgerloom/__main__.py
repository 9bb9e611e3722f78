"""python -m ledgerloom LINES OUT [--cache DIR] [--sample LINES] [--only ANALYSIS ...]: retail reports of a table of transaction lines."""

from __future__ import annotations

import argparse

from .plans import reports
from .session import session


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="ledgerloom", description="Write the retail reports of a table of transaction lines (Parquet, CSV or .xlsx).")
    parser.add_argument("lines")
    parser.add_argument("out")
    parser.add_argument("--sample", help="lines to use where LINES does not exist")
    parser.add_argument("--cache", help="folder of the stored cleaned lines; read where it fits LINES, else made from them")
    parser.add_argument("--rebuild", action="store_true", help="make the cache anew")
    parser.add_argument("--only", nargs="+", choices=list(reports.ANALYSES), metavar="ANALYSIS", help=f"of {', '.join(reports.ANALYSES)}; all by default")
    args = parser.parse_args(argv)
    spark = session()
    if args.cache:
        frames, note = reports.stored_frames(spark, args.lines, args.cache, args.sample, args.rebuild)
        held = None
    else:
        raw, note = reports.load_or_sample(spark, args.lines, args.sample)
        frames = reports.frames_of(held := raw.persist())
    print(note)
    for name in reports.export(frames, args.out, only=args.only):
        print("wrote", name)
    if held is not None:
        held.unpersist()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
