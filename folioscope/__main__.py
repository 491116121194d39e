"""Run the stages of a corpus: python -m folioscope --run-dir DIR [STAGE ...] [--start-from STAGE] [--exclude STAGE ...]."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from .plans import stages
from .session import session


def main(words: Sequence[str] | None = None) -> list[str]:
    """Run the stages chosen over the folder's inputs and what earlier runs have left there; their names."""
    order = list(stages.STAGES)
    parser = argparse.ArgumentParser(prog="folioscope", description="Run the stages of a corpus, in order.")
    parser.add_argument("stages", nargs="*", metavar="STAGE", help=f"a choice of {', '.join(order)}; all without one")
    parser.add_argument("--start-from", choices=order, metavar="STAGE", help="leave out the stages before this one")
    parser.add_argument("--exclude", action="append", nargs="+", choices=order, default=[], metavar="STAGE", help="stages to leave out")
    parser.add_argument("--run-dir", required=True, help="folder with the table folder input; results go beside it")
    chosen = parser.parse_args(words)
    try:
        names = stages.resolve(chosen.stages, chosen.start_from, [s for group in chosen.exclude for s in group])
    except ValueError as e:
        parser.error(str(e))
    spark = session()
    stages.run(spark, stages.held(spark, chosen.run_dir, names[0]), names, chosen.run_dir)
    return names


if __name__ == "__main__":
    main()
