"""python -m tidemill collect ANSWERS OUT [options]: a batch from stored answers, merged into the snapshot under OUT.
python -m tidemill audit ARTEFACT: checks the JSON array, JSON lines, snapshot or batches of a run.
python -m tidemill directory WORDS FOUND: shows what searches of the media directory found, and the ids to configure.

ANSWERS has <keyword>/<platform>/<step>-<page>.<ext>, and for --fetch-news-detail _articles/ with JSON lines of url and html.
WORDS is a text list of searched words; FOUND has JSON lines of word, item_ix and item."""

from __future__ import annotations

import datetime
import sys

from pyspark.sql import SparkSession

from .operators import audit, directory
from .plans import collect, spec


def main(argv: list[str]) -> int:
    if len(argv) < 2 or argv[0] not in ("collect", "audit", "directory") or (argv[0] != "audit" and len(argv) < 3):
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("tidemill").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if argv[0] == "audit":
        try:
            found = audit.report(spark, argv[1])
        except (FileNotFoundError, ValueError) as e:
            print(e)
            return 1
        print(f"records: {found['records']}\ncomplete: {found['complete']}")
        found["families"].show(truncate=False)
        found["head"].show()
        return 0
    if argv[0] == "directory":
        results = directory.search_results(directory.distinct_words(directory.read_words(spark, argv[1])), directory.read_found(spark, argv[2]))
        directory.show_items(results).orderBy("ord", "item_ix").drop("ord").show(1000, truncate=False)
        print(directory.id_setting(results).first()["ids"])
        return 0
    wanted = spec.parse(argv[3:])
    details = collect.read_details(spark, argv[1]) if wanted.fetch_news_detail else None
    collect.run(spark, wanted, collect.read_answers(spark, argv[1]), argv[2], datetime.datetime.now(), details).show()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
