"""Extra columns of any name, the operators' own and those in another letter case among them."""

import pytest

pytest.importorskip("stratalith.llm.queries")
from fixtures import documents  # noqa: E402

from stratalith.llm.exact_dedup import exact_duplicates  # noqa: E402
from stratalith.llm.line_dedup import dedup_lines  # noqa: E402
from stratalith.llm.packing import pack  # noqa: E402
from stratalith.llm.quality import quality  # noqa: E402
from stratalith.llm.simhash import keep_one, near_duplicates  # noqa: E402
from stratalith.llm.suffix_dedup import drop_repeats  # noqa: E402
from stratalith.llm.toxicity import toxicity  # noqa: E402

EXTRA = ["a.b", "w`x", "N_DROPPED", "n_lines", "N_Words", "TOXICITY", "Toxic", "KEPT", "quality_score", "key", "spans", "lost", "stratalith_0", "Passages", "fp", "digest", "words"]


def odd(spark):
    docs = documents(spark, ["One line of some length here\nmore", "Other words\nOne line of some length here", None, ""]).select("text", "doc_id")
    for name in EXTRA:
        docs = docs.selectExpr("*", f"concat(doc_id, '-') as `{name.replace('`', '``')}`")
    return docs


@pytest.mark.parametrize(
    "work, new",
    [
        (dedup_lines, ["n_lines", "n_dropped"]),
        (drop_repeats, ["n_words", "n_dropped", "passages", "sources"]),
        (quality, ["quality_score", "kept"]),
        (lambda d: toxicity(d, d.sparkSession.createDataFrame([(10, 1), (11, 0)], "doc_id long, toxic int")), ["toxicity", "toxic"]),
    ],
)
def test_columns_stay(spark, work, new):
    docs = odd(spark)
    out = work(docs)
    kept = [c for c in docs.columns if c.lower() not in new]
    assert out.columns == kept + new
    rows = out.collect()
    assert len(rows) == 4
    for row in rows:
        assert all(row[i] == f"{row['doc_id']}-" for i, c in enumerate(kept) if c not in ("doc_id", "text"))


def test_columns_do_not_matter(spark):
    docs = odd(spark)
    plain = docs.select("doc_id", "text")
    for work in (exact_duplicates, near_duplicates, lambda d: pack(d).drop("sequence_id", "offset")):
        assert sorted(map(str, work(docs).collect())) == sorted(map(str, work(plain).collect()))
    assert keep_one(docs).columns == docs.columns
    assert keep_one(docs).count() == keep_one(plain).count()


def test_session_stays_as_it_was(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    exact_duplicates(odd(spark)).count()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
