"""python -m sealwright MANIFEST FOLDER CONTRACTS OUT: the batch run over a manifest's files.

CONTRACTS is a JSON file of contracts by name, each in any language that adapt() reads. Exit code 0 if no row failed,
1 if some did, 2 if the run could not begin.
"""

from __future__ import annotations

import json
import sys
from pathlib import Path


def main(arguments: list[str]) -> int:
    if len(arguments) != 4:
        print(__doc__, file=sys.stderr)
        return 2
    manifest_path, folder, contracts, out = arguments
    if not Path(contracts).is_file():
        print(f"no file {contracts}", file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    from .errors import EngineError
    from .sources import manifest

    spark = SparkSession.builder.appName("sealwright").getOrCreate()
    try:
        _, summary = manifest.run(spark, manifest_path, folder, json.loads(Path(contracts).read_text()), out)
    except EngineError as e:
        print(f"{e.code}: {e}", file=sys.stderr)
        return 2
    found = summary.first()
    for name in found.asDict():
        print(f"{name}: {found[name]}")
    return 1 if found["failed"] else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
