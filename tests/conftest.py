import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from gridquill.session import local_session

    return local_session(4, "tests", "4g")


@pytest.fixture(scope="session")
def small():
    folder = "/root/testdata/sf0.001"
    if not Path(folder).exists():
        pytest.skip("no test data")
    return folder


TABLES = ["papers", "gt_tables", "gt_cells", "gt_mentions", "ocr_pages", "corpus_records", "documents", "section_list", "unit_targets", "source_targets"]
CLASHING = ["k", "v", "t", "r", "n", "s", "i", "d", "label", "unit", "value", "tail", "parts", "plain", "head", "heads", "units", "entity", "quantity", "grp", "path", "kind", "doc_no", "item_no", "defects", "headers", "cut", "ids", "n_tokens", "times", "chains", "lost", "entry_id", "score", "line", "word", "words"]


@pytest.fixture(scope="session")
def variants(spark, small, tmp_path_factory):
    """Folders with the smallest tables: a seventh of all values null, every value null, no rows, extra columns."""
    from pyspark.sql import functions as F

    def some_null(df):
        return df.select(*[F.when(F.rand(i) < 0.15, None).otherwise(F.col(c)).alias(c) for i, c in enumerate(df.columns)])

    def all_null(df):
        return df.limit(20).select(*[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns])

    kinds = {"nulls": some_null, "all_null": all_null, "empty": lambda df: df.limit(0), "extra": lambda df: df.withColumns({c: F.lit("x") for c in CLASHING if c not in df.columns})}
    out = {}
    for name, change in kinds.items():
        out[name] = str(tmp_path_factory.mktemp(name))
        for t in TABLES:
            change(spark.read.parquet(f"{small}/{t}.parquet")).write.parquet(f"{out[name]}/{t}.parquet")
    return out


def holds_on_variants(query, spark, small, variants):
    assert query(spark, variants["empty"]).count() == 0 or query.__name__ == "p7_shares"
    assert query(spark, variants["extra"]).count() == query(spark, small).count()
    for kind in ("nulls", "all_null"):
        query(spark, variants[kind]).count()
