"""Cue words of many categories counted in one pass over a text, from rule tables that are files.

A rule file is a JSON object of lists of words by category. The words of all categories become one
Aho-Corasick automaton, which a task builds once; a text is walked once however many words there are.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import let_workers_import, table
from ..sources.stores import new_folder
from .scoring import CONCEPT_WORDS, CUES, DIAGRAM_WORDS, RULE_WORDS

#: Largest rule file that the driver reads and tasks get.
MOST_BYTES = 16 << 20


def load_cues(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Words by category of a rule file on any file system. Empty words are left out; other shapes and files of over 16 MB raise ValueError."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength() > MOST_BYTES:
        raise ValueError(f"{path} is over {MOST_BYTES} bytes")
    rules = json.loads("".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
    if not isinstance(rules, dict) or not all(isinstance(ws, list) and all(isinstance(w, str) for w in ws) for ws in rules.values()):
        raise ValueError(f"{path} is no object of lists of words")
    return {k: [w for w in ws if w] for k, ws in rules.items()}


class Cues:
    """An automaton over the words of all categories."""

    def __init__(self, rules: dict[str, list[str]]):
        self.width = len(rules)
        self.words: dict[str, list[int]] = {}
        for k, ws in enumerate(rules.values()):
            for w in ws:
                self.words.setdefault(w, []).append(k)
        self.automaton = ahocorasick.Automaton()
        for w, kinds in self.words.items():
            self.automaton.add_word(w, (w, kinds))
        self.automaton.make_automaton()

    def counts(self, text: str | None) -> list[int]:
        """Occurrences by category; those of one word do not overlap each other, from the left, those of different words may."""
        out, ends = [0] * self.width, {}
        if text and self.words:
            for end, (word, kinds) in self.automaton.iter(text):
                if end - len(word) >= ends.get(word, -1):
                    ends[word] = end
                    for k in kinds:
                        out[k] += 1
        return out


def _counted(rules: dict[str, list[str]], lower: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cues = Cues(rules)
        for batch in batches:
            texts = batch.column("cue_text").to_pylist()
            counts = [cues.counts(t.lower() if lower and t else t) for t in texts]
            rest = [n for n in batch.schema.names if n != "cue_text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array(counts, pa.list_(pa.int64()))], names=[*rest, "cue_counts"])

    return run


def count_cues(rows: DataFrame, text: str, keep: list[str], rules: dict[str, list[str]], lower: bool = False) -> DataFrame:
    """The columns `keep` of rows, and one long column per category: how often its words occur in the text, each as str.count counts.

    A word that a category lists twice counts twice, one of several categories in each. Null and empty texts
    hold none. `lower` counts in the text in lower case; words stay as they are. Rows stay one for one.
    """
    let_workers_import(rows.sparkSession)
    own = rows.select(*keep, F.col(text).alias("cue_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1]), "cue_counts array<bigint>"])
    return own.mapInArrow(_counted(rules, lower), schema).select(*keep, *(F.col("cue_counts")[i].alias(k) for i, k in enumerate(rules)))


def signals(counted: DataFrame, key: str, categories: list[str]) -> DataFrame:
    """key, category and n of the categories that occur, most frequent first in rank (ties by the order of the categories)."""
    found = F.filter(F.array(*(F.struct((-F.col(c)).alias("m"), F.lit(i).alias("i"), F.lit(c).alias("category")) for i, c in enumerate(categories))), lambda s: s["m"] < 0)
    each = counted.select(key, F.posexplode(F.array_sort(found)).alias("pos", "s"))
    return each.select(key, F.col("s.category").alias("category"), (-F.col("s.m")).alias("n"), (F.col("pos") + 1).alias("rank"))


#: Words of the given prose, some inside others: a rule table beside the fixed ones.
PROSE = {"articles": ["the", "der", "la", "el"], "endings": ["ing", "in", "ng"], "doubled": ["ll", "ss", "ee"]}
_ALL = CUES | {"diagram": DIAGRAM_WORDS, "concept": CONCEPT_WORDS, "rule": RULE_WORDS} | PROSE


def _rule_file(spark: SparkSession) -> str:
    path = new_folder(spark, "cues")
    spark.createDataFrame([(json.dumps(_ALL, ensure_ascii=False),)], "value string").coalesce(1).write.text(path)
    return path


def s17_cue_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues of all categories of a rule file in each document."""
    return count_cues(table(spark, sf_dir, "documents"), "text", ["doc_id"], load_cues(spark, _rule_file(spark)))


def a09_ranked_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories of a rule file by how often their words occur in each turn."""
    rules = load_cues(spark, _rule_file(spark))
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("turn_id"), "text")
    return signals(count_cues(turns, "text", ["turn_id"], rules, lower=True), "turn_id", list(rules))


QUERIES = {q.__name__: q for q in (s17_cue_tables, a09_ranked_signals)}


def _count_sql(text: str, words: list[str]) -> str:
    return "(" + " + ".join(f"(length({text}) - length(replace({text}, '{w}', ''))) // {len(w)}" for w in words) + ")"


ORACLES = {
    "s17_cue_tables": "SELECT doc_id, " + ", ".join(f"{_count_sql('t', ws)} AS {k}" for k, ws in _ALL.items()) + " FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)",
    "a09_ranked_signals": "WITH t AS (SELECT concat_ws('/', conv_id, turn) AS id, lower(coalesce(text, '')) AS t, row_number() OVER () AS r FROM conversations), c AS ("
    + " UNION ALL ".join(f"SELECT id, {i} AS i, '{k}' AS category, {_count_sql('t', ws)} AS n, r FROM t" for i, (k, ws) in enumerate(_ALL.items()))
    + ") SELECT id AS turn_id, category, n, CAST(row_number() OVER (PARTITION BY r ORDER BY n DESC, i) AS INTEGER) AS rank FROM c WHERE n > 0",
}
