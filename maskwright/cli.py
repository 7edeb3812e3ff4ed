"""python -m maskwright.cli --corpus FILE [--solution NAME... | --preset NAME] [--format markdown|text] [--out DIR] | --selftest: reports over a labelled
corpus."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

from .operators.detect import Dictionary
from .plans import reports
from .session import build_session
from .sources import readers, sinks


PRESETS = {"light": ("allowlisted",), "wide": ("all-types",), "all": ("all",)}


def selftest(spark: SparkSession, corpus: DataFrame) -> int:
    """Redact with a dictionary of the corpus's own labels: no carrier may leak, every round trip must hold. Returns the
    number of failures. The dictionary is built on the driver: a self-test corpus is small (checked)."""
    rows = sinks.small(corpus.select(F.explode("expected").alias("pii", "type")).distinct().orderBy("pii", "type"))
    terms = tuple({r["pii"]: r["type"] for r in rows if r["pii"]}.items())
    found = sinks.small(reports.carrier_report(corpus, reports.Solution("dictionary", (Dictionary(terms),))))
    # what flat text lacks no carrier can be blamed for: the baseline must be complete
    flat = next(r for r in found if r["carrier"] == "flat")
    if flat["anonymized"] != flat["labels"]:
        raise AssertionError(f"flat text: {flat['anonymized']} of {flat['labels']} values replaced")
    return sum(r["leaked"] + r["regressions"] + r["rt_failed"] for r in found)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--corpus", nargs="+", required=True)
    parser.add_argument("--solution", nargs="+", choices=[s.name for s in reports.default_solutions()] + ["all"], default=["all"])
    parser.add_argument("--preset", choices=sorted(PRESETS), help="a named choice of solutions")
    parser.add_argument("--format", choices=["markdown", "text"], default="markdown")
    parser.add_argument("--out")
    parser.add_argument("--selftest", action="store_true")
    args = parser.parse_args(argv)
    spark = build_session()
    corpus = readers.corpora(spark, args.corpus)
    if args.selftest:
        failures = selftest(spark, corpus)
        print(f"self-test: {failures} failures")
        return int(failures > 0)
    chosen = PRESETS[args.preset] if args.preset else args.solution
    solutions = [s for s in reports.default_solutions() if "all" in chosen or s.name in chosen]
    sections = reports.comparison_report(corpus, solutions)
    for s in solutions:
        sections |= {f"{s.name}: {k}": v for k, v in reports.precision_recall_report(corpus, s).items() if k != "items"} | {f"{s.name}: carriers": reports.carrier_report(corpus, s)}
    report = sinks.markdown_report if args.format == "markdown" else sinks.text_report
    print(report("Redaction report", sections, reports.caveats(sections)))
    if args.out:
        for name, df in sections.items():
            sinks.write_table(df, f"{args.out}/{name.replace(': ', '-')}", "json", "overwrite")
    return 0


if __name__ == "__main__":
    sys.exit(main())
