"""``python -m lexmill.extract PATH``: the terms of a text file, or of each file of a folder, to a result of text lines."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lexmill.operators import extraction
from lexmill.sources import files


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="lexmill.extract", description="Extract terms from text files")
    parser.add_argument("PATH", help="a text file in UTF-8, or a folder of such files")
    parser.add_argument("--sent_by_part", "-s", nargs="+", type=int, default=[40], help="sentences in a part, one number or more")
    parser.add_argument("--min_count", "-m", type=int, default=5, help="least number of occurrences of a term")
    parser.add_argument("--limit", "-l", type=int, default=None, help="keep only so many terms of each ranking")
    parser.add_argument("--stopwords", default=None, help="a file of stop words")
    parser.add_argument("--result", default="result", help="the folder of results")
    return parser.parse_args(given)


def run(spark: SparkSession, path: str, sent_by_part: list[int], min_count: int, limit: int | None, result: str, stopwords: str | None = None) -> str:
    """Write the terms all rankings agree on; the path of the result. A file of a folder has a folder of its own in it."""
    texts = files.whole_text(spark, path).select(F.input_file_name().alias("file"), "text")
    stop = [r.word for r in files.wordset(spark, stopwords).collect()] if stopwords else ["-"]  # a short list by its nature
    ranked = extraction.rankings(texts, stop, sent_by_part=sent_by_part, min_count=min_count, limit=limit, key="file")
    found = extraction.agreed(ranked, "file")
    target = f"{result}/extracted-min{min_count}{f'-lim{limit}' if limit else ''}.txt"
    shown = f"sent_by_part={','.join(map(str, sent_by_part))} limit={limit} min_count={min_count}"
    files.write_terms_by_text(texts.select("file"), found, target, shown)
    return target


def main(given: list[str] | None = None) -> int:
    asked = arguments(given)
    if asked.min_count < 1 or (asked.limit is not None and asked.limit < 1) or min(asked.sent_by_part) < 1:
        print("limit, min_count and sent_by_part must be positive", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("lexmill.extract").getOrCreate()
    print(run(spark, asked.PATH, asked.sent_by_part, asked.min_count, asked.limit, asked.result, asked.stopwords))
    return 0


if __name__ == "__main__":
    sys.exit(main())
