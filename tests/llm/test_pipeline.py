"""The pipeline's stages on the small tables: each keeps its contract, its decisions take effect."""

import corpus_pipeline
from pluvia.llm import decontamination, simhash_dedup
from pluvia.llm.common import stored, table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), name)
        seen.append(docs)
    ids = [{r[0] for r in d.select("doc_id").collect()} for d in seen]
    assert all(d.columns == columns for d in seen[:-1])
    assert ids[0] > ids[1] == ids[2] >= ids[3] >= ids[4] == ids[5]
    assert decontamination.leak_report(seen[4], table(spark, SF, "benchmark")).count() == 0
    assert simhash_dedup.keep_leaders(seen[3]).count() == seen[3].count()


def test_registered_queries_are_whole(spark):
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
