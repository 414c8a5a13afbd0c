"""Chat formatting by schema fingerprints.

A record is a JSON object. Its nested field paths are hashed to a fingerprint; the first sight of a
fingerprint picks a declarative mapping (where the turns are, which fields are role and text), and
later records of that layout go straight to it. Canonical turns are rendered with a template that
marks turns and escapes its control strings inside texts, so that the output reads back exactly.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Layouts in order of preference. `turns`: the list with role and text fields, `roles`: what its role names stand for; `fields`: (role, field) in order; `pairs`: a list of records with such fields.
LAYOUTS = [
    {"name": "messages", "turns": "messages", "role": "role", "text": "content"},
    {"name": "turns", "turns": "turns", "role": "role", "text": "text"},
    {"name": "conversations", "turns": "conversations", "role": "from", "text": "value", "roles": {"human": "user", "gpt": "assistant"}},
    {"name": "dialog", "turns": "dialog", "role": "speaker", "text": "utterance", "roles": {"human": "user", "bot": "assistant", "model": "assistant"}},
    {"name": "instruction_input", "fields": [("system", "instruction"), ("user", "input"), ("assistant", "output")]},
    {"name": "instruction", "fields": [("user", "instruction"), ("assistant", "output")]},
    {"name": "prompt_completion", "fields": [("system", "system"), ("user", "prompt"), ("assistant", "completion")], "optional": ["system"]},
    {"name": "prompt_response", "fields": [("user", "prompt"), ("assistant", "response")]},
    {"name": "question_answer", "fields": [("user", "question"), ("assistant", "answer")]},
]


def paths(value) -> set[str]:
    """Nested field paths of a record, of any depth; list elements share the path `[]`."""
    found, todo = set(), [("", value)]
    while todo:
        at, x = todo.pop()
        if at or not isinstance(x, dict):
            found.add(at)
        if isinstance(x, dict):
            todo += [(f"{at}.{k}" if at else k, v) for k, v in x.items()]
        elif isinstance(x, list):
            todo += [(f"{at}[]", v) for v in x]
    return found


def fingerprint(found: set[str]) -> int:
    """Hash of a record's field paths."""
    return xxhash.xxh64_intdigest("\n".join(sorted(found)).encode("utf-8", "surrogatepass"))


class LayoutTable:
    """Mappings by fingerprint, confirmed by the paths; of ever new layouts the ones asked for last stay."""

    def __init__(self, layouts: list[dict], most: int = 1024):
        self.layouts, self.most = layouts, most
        self.known: dict[int, tuple[frozenset[str], dict | None]] = {}

    def layout(self, record: dict) -> dict | None:
        have = paths(record)
        mark = fingerprint(have)
        held = self.known.pop(mark, None)
        if held is None or held[0] != have:
            held = frozenset(have), next((x for x in self.layouts if self._fits(x, have)), None)
        self.known[mark] = held
        if len(self.known) > self.most:
            del self.known[next(iter(self.known))]
        return held[1]

    @staticmethod
    def _fits(layout: dict, have: set[str]) -> bool:
        if "turns" in layout:
            t = layout["turns"]
            return t in have and (f"{t}[]" not in have or {f"{t}[].{layout['role']}", f"{t}[].{layout['text']}"} <= have)
        return {f for _, f in layout["fields"]} - set(layout.get("optional", ())) <= have

    def turns(self, record: dict) -> list[tuple[str, str]] | None:
        layout = self.layout(record)
        if layout is None:
            return None
        if "turns" in layout:
            own = record[layout["turns"]]
            if not isinstance(own, list) and own is not None:
                return None
            found = [(x.get(layout["role"]), x.get(layout["text"])) for x in own or [] if isinstance(x, dict)]
        else:
            found = [(role, record.get(f)) for role, f in layout["fields"] if f in record]
        names = layout.get("roles", {})
        return [(names.get(r, r), t) for r, t in ((_plain(r), _plain(t)) for r, t in found)]


def _plain(value) -> str:
    """A text as it is, lone surrogates as U+FFFD; null as empty; any other value as JSON."""
    text = value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)
    return text if text.isascii() else text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


#: The template's control strings, fixed values of a widely used chat format; `[ROLE]` ... `[/ROLE]` holds any other role.
CONTROLS = ["[INST]", "[/INST]", "</s>", "[ROLE]", "[/ROLE]", "[TEXT]"]
_ESCAPED = re.compile("|".join(re.escape(c) for c in ["\\", *CONTROLS]))
_MARKS = re.compile(r"\\.|" + "|".join(re.escape(c) for c in CONTROLS), re.S)


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(turns: list[tuple[str, str]]) -> str:
    """user: [INST] text [/INST]; assistant: text</s>; others: [ROLE]role[TEXT]text[/ROLE]."""
    form = {"user": "[INST] {1} [/INST]", "assistant": "{1}</s>"}
    return "".join(form.get(r, "[ROLE]{0}[TEXT]{1}[/ROLE]").format(escape(r), escape(t)) for r, t in turns)


def read_back(formatted: str) -> tuple[list[tuple[str, str]], list[tuple[int, int]]]:
    """The turns of a rendered conversation and the spans of it that training loss covers (assistant texts)."""
    turns, loss, at, role, start = [], [], 0, None, 0
    for m in _MARKS.finditer(formatted):
        mark = m[0]
        if mark[0] == "\\":
            continue
        if mark == "[/INST]":
            turns.append(("user", unescape(formatted[start + 1 : m.start() - 1])))
        elif mark == "</s>":
            turns.append(("assistant", unescape(formatted[at : m.start()])))
            loss.append((at, m.start()))
        elif mark == "[TEXT]":
            role = unescape(formatted[start : m.start()])
        elif mark == "[/ROLE]":
            turns.append((role, unescape(formatted[start : m.start()])))
        start = at = m.end()
    return turns, loss


def format_records(records: DataFrame, record: str = "record", layouts: list[dict] | None = None) -> DataFrame:
    """Format JSON records: adds formatted, turns (role and text, as read back), loss_text and layout.

    loss_text is all text under the loss mask, unescaped, in order. A record that is null, no JSON
    object, nested too deeply for the JSON reader, or of no known layout (the turns being no list
    included) gets nulls. Null roles and texts count as empty, roles and texts that are no strings are
    taken as their JSON, lone surrogates become U+FFFD, elements of the list that are no objects are
    left out; an empty or null list of turns gives an empty conversation. Other columns pass through, but columns named as the new ones are replaced.
    """
    new = ["formatted", "turns", "loss_text", "layout"]
    rows = records.drop(*new)
    schema = f"{rows._jdf.schema().toDDL()}, formatted string, turns array<struct<role: string, text: string>>, loss_text string, layout string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = LayoutTable(layouts or LAYOUTS)
        kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for batch in batches:
            out: list[tuple] = []
            for raw in batch.column(record).to_pylist():
                try:
                    value = json.loads(raw) if raw else None
                    turns = table.turns(value) if isinstance(value, dict) else None
                except (ValueError, RecursionError):
                    turns = None
                if turns is None:
                    out.append((None,) * 4)
                    continue
                text = render(turns)
                again, loss = read_back(text)
                out.append((text, [{"role": r, "text": t} for r, t in again], "".join(unescape(text[a:b]) for a, b in loss), table.layout(value)["name"]))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            kinds = [pa.string(), kind, pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[*batch.schema.names, *new])

    return rows.mapInArrow(run, schema)


#: Spark SQL of one record for each layout, from the turns `t` of role r and text x.
_AS_LAYOUT = {
    "turns": "to_json(struct(transform(t, y -> struct(y.role as role, y.text as text)) as turns))",
    "messages": "to_json(struct(transform(t, y -> struct(y.role as role, y.text as content)) as messages))",
    "conversations": "to_json(struct(transform(t, y -> struct(case y.role when 'user' then 'human' when 'assistant' then 'gpt' else y.role end as from, y.text as value)) as conversations))",
    "dialog": "to_json(struct(transform(t, y -> struct(case y.role when 'user' then 'human' when 'assistant' then 'bot' else y.role end as speaker, y.text as utterance)) as dialog))",
    "prompt_response": "to_json(struct(t[0].text as prompt, t[1].text as response))",
    "instruction": "to_json(struct(t[0].text as instruction, t[1].text as output))",
    "question_answer": "to_json(struct(t[0].text as question, t[1].text as answer))",
}


def conversation_records(rows: DataFrame) -> DataFrame:
    """conv_id and a JSON record of the turns of conversations(conv_id, turn, role, text), by turn (null first), role and text.

    Records come in mixed layouts, as in a corpus of many sources: those of one user and one assistant
    turn as prompts, instructions or questions, others as one of four kinds of turn lists; a hash of
    conv_id chooses. Roles other than user, assistant and system keep their names in `turns` records.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    each = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t")).withColumn("h", F.expr("pmod(xxhash64(conv_id), 12)"))
    pick = lambda names: " ".join(f"when {i} then {_AS_LAYOUT[n]}" for i, n in enumerate(names))
    record = f"""case when exists(t, y -> y.role not in ('user', 'assistant', 'system')) then {_AS_LAYOUT["turns"]}
        when size(t) = 2 and t[0].role = 'user' and t[1].role = 'assistant' then case h % 3 {pick(("prompt_response", "instruction", "question_answer"))} end
        else case h % 4 {pick(("turns", "messages", "conversations", "dialog"))} end end"""
    return each.select("conv_id", F.expr(record).alias("record"))
