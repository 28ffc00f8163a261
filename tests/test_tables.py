import pytest

from verdigris.functions import tables


@pytest.fixture()
def tools(spark):
    tables.register(spark)
    return spark


def test_segments_sum_whole_documents(tools):
    hits = "select * from values (1, 0, array(7, 8), array(1.0D, 2.0D)), (1, 0, array(7, 9), array(1.0D, 2.0D)), (2, 0, array(5), array(1.0D)), (2, 1, null, null) t(query_id, block, docs, parts)"
    got = tools.sql(f"select * from search_docs(table({hits}) partition by (query_id, block), 2)").collect()
    # three documents of question 1 have the same score, so the smaller two are told
    assert sorted(map(tuple, got)) == [(1, 7, 2.0), (1, 8, 2.0), (2, 5, 1.0)]
    for wrong in (f"search_docs(table(select query_id from ({hits})) partition by query_id, 2)", f"search_docs(table({hits}) partition by (query_id, block), 0)", "calculate(3)"):
        with pytest.raises(Exception, match="lacks|whole number|expression"):
            tools.sql(f"select * from {wrong}").collect()


def test_documents_and_sums(tools):
    rows = "select * from values ('1', 'x', false), ('1', null, true), ('1', null, true), ('2', null, true), ('3', null, false), ('3', null, true) t(doc_id, text, asked)"
    got = tools.sql(f"select * from get_doc(table({rows}) partition by doc_id order by asked)").collect()
    assert sorted(map(tuple, got), key=repr) == [("1", "x"), ("1", "x"), ("2", "error: no document 2"), ("3", None)]
    got = tools.sql("select value, error from values ('1 + 2'), ('1 / 0'), (null) t(e), lateral calculate(e)").collect()
    assert sorted(map(tuple, got), key=repr) == [("3", None), (None, "division by zero"), (None, None)]


def test_folding_of_every_character(spark):
    from pyspark.sql import functions as F

    from verdigris.functions import text

    every = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    rows = [("".join(every[i : i + 512]), "".join(every[i : i + 512]).casefold()) for i in range(0, len(every), 512)] + [("ΣΊΣΥΦΟΣ ﬁn İ STRASSE straße", "ΣΊΣΥΦΟΣ ﬁn İ STRASSE straße".casefold())]
    df = spark.createDataFrame(rows, "t string, folded string")
    assert df.filter(text.fold(F.col("t")) != F.col("folded")).count() == 0
    same = spark.createDataFrame([("Ὀδυσσεύς!", "ὈΔΥΣΣΕΎΣ"), ("ﬂat", "FLAT"), ("MASSE", "Maße")], "a string, r string")
    assert same.filter(text.match_answer(F.col("a"), F.col("r"), F.lit("exact"))).count() == 3
