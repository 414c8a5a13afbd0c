"""One expression text in two dialects, so that a long predicate and its check cannot drift apart."""

from __future__ import annotations

#: Mark -> Spark SQL, DuckDB SQL.
MARKS = {
    "@like(": ("regexp_like(", "regexp_matches("),
    "@split(": ("split(", "regexp_split_to_array("),
    "@filter(": ("filter(", "list_filter("),
    "@map(": ("transform(", "list_transform("),
    "@join(": ("array_join(", "array_to_string("),
    "@all(": ("regexp_extract_all(", "regexp_extract_all("),
    "@size(": ("size(", "len("),
    "@whole)": (", 0)", ")"),
    "@every)": (")", ", 'g')"),
    "@take(": ("slice(", "list_slice("),
    "@both(": ("concat(", "list_concat("),
    "@before(": ("substring_index(", "split_part("),
    "@[": ("array(", "["),
    "@]": (")", "]"),
    "@1": ("$1", "\\1"),
    "@lambda ": ("", "lambda "),
    "@to": (" ->", ":"),
    "@'": ("r'", "'"),
}


def spark_sql(text: str) -> str:
    for mark, (own, _) in MARKS.items():
        text = text.replace(mark, own)
    return text


def duck_sql(text: str) -> str:
    for mark, (_, other) in MARKS.items():
        text = text.replace(mark, other)
    return text
