import math

import pytest
from pyspark.sql import functions as F

from sedimenta.operators import indexing, retrieval, search


def test_fusion_counts_repeats_half(spark):
    rows = [(1, 10, 10, 1, 7, 0.8), (1, 11, 5, 1, 7, 0.6), (1, 11, 5, 2, 8, 0.5), (2, 12, 1, 1, 7, 0.4)]
    df = spark.createDataFrame(rows, "request long, query_id long, weight int, rank int, vec_id long, score double")
    got = {(r.request, r.vec_id): (r.fused, r.queries, r.rank) for r in search.fused(df, 5).collect()}
    assert got == {(1, 7): (1.575, "10,11", 1), (1, 8): (0.625, "11", 2), (2, 7): (0.42, "12", 1)}
    one = {r.vec_id: r.fused for r in search.fused(df.where("query_id = 10"), 5).collect()}
    assert one == {7: 1.2}


def test_cosine_of_odd_vectors(spark):
    rows = [([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([], []), (None, [1.0]), ([1.0], [1.0, 2.0]), ([2.0], [-3.0])]
    got = [r.c for r in spark.createDataFrame(rows, "a array<double>, b array<double>").select(search.cosine("a", "b").alias("c")).collect()]
    assert got == pytest.approx([1 / math.sqrt(2), 0, 0, 0, 0, -1])


def test_vectors_meet_only_their_own_length(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0], 1), (3, [0.0, 1.0, 0.0], 1), (4, [], 1), (50, [1.0, 0.0, 0.0], 2), (51, [0.0, 1.0, 0.0], 2), (52, [0.0, 1.0, 0.0], 2), (100, [1.0] * 5, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted((r.query_id, r.collection, r.vec_id, r.place) for r in retrieval.nearest_per_collection(df, 2).collect())
    assert got == [(0, 1, 1, 1), (50, 1, 3, 1), (50, 2, 51, 1), (50, 2, 52, 2)]
    assert retrieval.nearest_per_collection(df.limit(0), 2).count() == 0


def test_types_by_name_and_path(spark):
    df = spark.createDataFrame([("dfd_rules_x.json", "a/rules/theory/x"), ("theoryx", "rulesets/x"), (None, None), ("x_domain", "levels/concepts")], "n string, p string")
    got = [tuple(r) for r in df.select(indexing.type_by_name(F.col("n")), indexing.type_by_path(F.col("p"))).collect()]
    assert got == [("diagrams.dfd.rules", "diagrams.dfd.rules"), ("theory", "unknown"), (None, "unknown"), (None, "diagrams.dfd.concepts")]


def test_chunks_of_lists_that_are_none(spark):
    rows = [
        ("examples", '{"case_name": "c", "dfd_elements": "none", "requirements_text": "text"}'),
        ("examples", '{"dfd_elements": {"processes": {"id": "p"}, "data_stores": [{"name": "s"}, 7, null]}}'),
        ("templates", '{"categories": [{"name": "k", "templates": [{"id": "t", "dfd_level": 2}, "x"]}, {"templates": "y"}]}'),
        ("templates", '{"categories": [{"name": "k"}]}'),
        ("concepts", "no json"),
        ("levels", '{"leveling_principles": [3, {"description": "d"}], "name": {"a": 1}}'),
    ]
    got = [(r.chunk_id, r.text) for r in indexing.chunks(spark.createDataFrame([(t, "s", b) for t, b in rows], "type_id string, stem string, body string")).collect()]
    assert got == [
        ("s_overview", "DFD案例: c\n描述: "),
        ("s_overview", "DFD案例: s\n描述: \n数据存储: s"),
        ("s_t", "DFD模板: \n分类: k\nDFD层级: Level-2\n模式类型: "),
        ("s_overview", "知识文件: s"),
        ("s_p_0", "DFD分层原则: p_0\n描述: d"),
    ]


def test_chunks_of_odd_bodies(spark):
    rows = [
        ("x.rules", '{"rules": [], "validation_rules": [{"name": "n", "detail": "d", "level": "error", "detect_logic": "l"}, 5]}'),
        ("x.rules", '{"description": "only"}'),
        ("concepts", '{"elements": [{"name": "n", "naming": "m", "properties": ["a", "b"], "examples": []}]}'),
        ("y", None),
        ("domain", '{"terms": [{"term": "t"}]}'),
        ("examples", '{"dfd_elements": {"processes": [{"id": "p", "name": "P"}], "data_flows": [{"from": "a", "to": "p", "data": "d1"}, {"from": "b", "to": "p", "data": "d2"}, {"from": "p", "to": "c"}]}}'),
    ]
    got = [(r.chunk_id, r.text) for r in indexing.chunks(spark.createDataFrame([(t, "s", b) for t, b in rows], "type_id string, stem string, body string")).collect()]
    assert got == [
        ("s_rule_0", "DFD规则: n\n规则ID: rule_0\n定义: d\n严重级别: error\n检测逻辑: l"),
        ("s_overview", "description: only"),
        ("s_elem_0", "DFD概念: n\n定义: \n命名规范: m\n特征: a; b"),
        ("s_overview", "知识文件: s"),
        ("s_overview", "领域: s\n描述: "),
        ("s_term_0", "领域术语: t\n领域: s\n定义: "),
        ("s_overview", "DFD案例: s\n描述: \n处理过程: P"),
        ("s_p", "处理过程: p P\n所属案例: s\n输入数据流: d1 (from a); d2 (from b)\n输出数据流:  (to c)"),
    ]
