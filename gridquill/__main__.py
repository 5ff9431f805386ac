"""Command line: generate, validate, evaluate, export, link, score.

    python -m gridquill generate --transcriptions FOLDER --output FOLDER [--keep-empty]
    python -m gridquill validate PATH
    python -m gridquill evaluate --reference PATH --prediction PATH [--report PATH]
    python -m gridquill export --corpus PATH --output FOLDER
    python -m gridquill link --corpus PATH --transcriptions FOLDER --output FOLDER
    python -m gridquill score --links FOLDER --labels PATH...
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gridquill.operators import claims as L
from gridquill.operators import context as X
from gridquill.plans import pipelines as P
from gridquill.session import local_session
from gridquill.sources import corpus as S
from gridquill.sources import extractors as E


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="gridquill")
    sub = top.add_subparsers(dest="command", required=True)
    g = sub.add_parser("generate")
    g.add_argument("--transcriptions", required=True)
    g.add_argument("--output", required=True)
    g.add_argument("--max-pages", type=int, default=0)
    g.add_argument("--keep-empty", action="store_true")
    v = sub.add_parser("validate")
    v.add_argument("path")
    e = sub.add_parser("evaluate")
    e.add_argument("--reference", required=True)
    e.add_argument("--prediction", required=True)
    e.add_argument("--report")
    x = sub.add_parser("export")
    x.add_argument("--corpus", required=True)
    x.add_argument("--output", required=True)
    k = sub.add_parser("link")
    k.add_argument("--corpus", required=True)
    k.add_argument("--transcriptions", required=True)
    k.add_argument("--output", required=True)
    k.add_argument("--max-candidates", type=int, default=0)
    k.add_argument("--only-referenced", action="store_true")
    c = sub.add_parser("score")
    c.add_argument("--links", required=True)
    c.add_argument("--labels", nargs="+", required=True)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.getActiveSession() or local_session()
    if a.command == "generate":
        pages = E.read_transcriptions(spark, a.transcriptions, a.max_pages).select("document_id", "page", "text")
        S.write_corpus(P.generate(pages, keep_empty=a.keep_empty), a.output)
    elif a.command == "validate":
        wrong, summary = P.validated(S.read_corpus(spark, a.path))
        rows = wrong.orderBy("document_id", "rule").limit(100).collect()  # the first of them, for the eye
        print(json.dumps({"summary": summary.first().asDict(), "violations": [r.asDict() for r in rows]}, indent=2))
        return int(bool(rows))
    elif a.command == "evaluate":
        rows = {r["field"]: {k: r[k] for k in ("accuracy", "precision", "recall", "f1")} for r in P.evaluate_files(spark, a.reference, a.prediction).collect()}  # six rows
        print(json.dumps(rows, indent=2))
        if a.report:  # the summary, and beside it a line per document
            with open(a.report, "w", encoding="utf-8") as f:
                json.dump(rows, f, indent=2)
            P.evaluation_report(spark, a.reference, a.prediction).write.mode("overwrite").json(f"{a.report}.documents")
    elif a.command == "export":
        P.exported(S.read_corpus(spark, a.corpus), a.corpus).write.mode("overwrite").text(a.output)
    elif a.command == "link":
        tables, _, _ = S.relational(S.read_corpus(spark, a.corpus))
        pages = E.read_transcriptions(spark, a.transcriptions).select("document_id", "page", "text")
        records, links = P.link_claims(X.document_sentences(pages), tables, settings=P.LinkSettings(most_candidates=a.max_candidates, only_referenced=a.only_referenced))
        predicted = L.predicted_tables(links)
        records.join(predicted, ["document_id", "sentence_id"], "left").withColumn("predicted", F.coalesce("predicted", F.lit(P.NONE))).write.mode("overwrite").parquet(f"{a.output}/records")
        links.write.mode("overwrite").parquet(f"{a.output}/links")
    else:
        row = L.scored_claims(spark.read.parquet(f"{a.links}/records"), S.read_labels(spark, a.labels)).first()
        print(json.dumps(row.asDict(), indent=2))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
