from collections import Counter

from plumbline.plans.catalog import module_relations
from plumbline.tsql.facts import facts

VIEW, PROC = "create view dbo.v as select a, b from dbo.t where a = 1", "create procedure dbo.p as set nocount on; update dbo.t set a = N'x''y' where [b]]c] = 2 /* a /* b */ c */ -- d"
MODULES = [(1, VIEW, "V"), (1, VIEW, "V"), (2, PROC, "P"), (2, VIEW, "V"), (3, None, "P"), (4, PROC, None), (None, PROC, "P"), (5, "", "FN")]


def test_counts_each_row_once_and_moves_no_fact(spark, tmp_path):
    spark.createDataFrame(MODULES, "module_id long, definition string, object_type_code string").write.parquet(f"{tmp_path}/live_modules.parquet")
    found = module_relations(spark, str(tmp_path))
    assert found.columns == ["object_type_code", "rel", "n"]
    want = Counter((kind, f[0]) for _, text, kind in MODULES if text is not None for f in facts(text))
    assert {(r.object_type_code, r.rel): r.n for r in found.collect()} == want
    assert "Join" not in found._jdf.queryExecution().toString()  # facts used to be sent to a join with the modules' kinds
