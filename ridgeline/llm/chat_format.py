r"""Chat formatting with schema fingerprints.

A record is JSON of some layout: messages, prompt and response, instruction with input and output.
Its fingerprint is a hash of those of its nested field paths (``messages[].role``) that any mapping
names, so that names, weights and other keys beside them play no part. It looks up a declarative
mapping, which names where the turns, roles and texts lie and how source roles become canonical ones.
A record whose fingerprint is unknown, as it has too few fields or those of several layouts, is
returned with no turns and ``layout`` null, never guessed at.

The template writes each turn as ``<|im_start|>role\ntext<|im_end|>\n``. A backslash in a role or
text is doubled, and one is put after the first character of whatever starts a control string there,
so that a formatted conversation has control strings only where the template set them, and every
text can be read back.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import small_batches

START, END = "<|im_start|>", "<|im_end|>\n"
#: Control strings of this and other templates; fixed values.
CONTROL = ["<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>", "<bos>", "<eos>", "<pad>", "<unk>", "[gMASK]", "<s_", "</s_"]
_STARTS = re.compile("(?s)(?=" + "|".join(map(re.escape, CONTROL)) + ")(.)")
_ESCAPED = re.compile(r"(?s)\\(.)")
_TURN = re.compile(r"(?s)<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n")


@dataclass(frozen=True)
class Layout:
    """fixed: (role, field) pairs in order, for records without a list; or a list field with role and text fields.

    optional fields may be missing. roles maps source roles; others stay as they are.
    """

    name: str
    fixed: tuple[tuple[str, str], ...] = ()
    turns: str = ""
    role: str = ""
    text: str = ""
    optional: tuple[str, ...] = ()
    roles: tuple[tuple[str, str], ...] = ()

    def paths(self) -> Iterator[frozenset[str]]:
        """Every set of field paths that this layout may have."""
        if self.turns:
            bases = [{self.turns, f"{self.turns}[].{self.role}", f"{self.turns}[].{self.text}"}, {self.turns}]  # the latter of an empty list
        else:
            bases = [{f for _, f in self.fixed} - set(self.optional)]
        yield from (frozenset(base | set(more)) for base in bases for n in range(len(self.optional) + 1) for more in itertools.combinations(self.optional, n))


#: Mappings looked up by fingerprint.
LAYOUTS = (
    Layout("messages", turns="messages", role="role", text="content", optional=("id", "system")),
    Layout("conversations", turns="conversations", role="from", text="value", optional=("id", "system"), roles=(("human", "user"), ("gpt", "assistant"), ("chatgpt", "assistant"), ("bot", "assistant"))),
    Layout("dialog", turns="dialog", role="speaker", text="text", optional=("id",), roles=(("human", "user"), ("bot", "assistant"), ("agent", "assistant"))),
    Layout("instruction", fixed=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")), optional=("system", "input", "id")),
    Layout("instruction-response", fixed=(("system", "system"), ("user", "instruction"), ("user", "context"), ("assistant", "response")), optional=("system", "context", "id")),
    Layout("prompt-response", fixed=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system", "id")),
    Layout("prompt-completion", fixed=(("system", "system"), ("user", "prompt"), ("assistant", "completion")), optional=("system", "id")),
    Layout("question-answer", fixed=(("system", "system"), ("user", "question"), ("assistant", "answer")), optional=("system", "id")),
)


def field_paths(value: object, at: str = "") -> set[str]:
    """Nested field paths of a JSON value; list places are ``[]``."""
    out: set[str] = set()
    if isinstance(value, dict):
        for k, v in value.items():
            path = f"{at}.{k}" if at else k
            out |= {path} | field_paths(v, path)
    elif isinstance(value, list):
        for v in value:
            out |= field_paths(v, f"{at}[]")
    return out


def fingerprint(paths: set[str] | frozenset[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def registry(layouts: tuple[Layout, ...] = LAYOUTS) -> dict[str, Layout]:
    return {fingerprint(p): layout for layout in reversed(layouts) for p in layout.paths()}


def named(layouts: tuple[Layout, ...] = LAYOUTS) -> frozenset[str]:
    """Every field path that a layout names."""
    return frozenset(p for layout in layouts for paths in layout.paths() for p in paths)


def _text(value: object) -> str:
    """A text as it is; of a list of parts their texts, one after the other; anything else as JSON."""
    if isinstance(value, list) and value and all(isinstance(p, str) or isinstance(p, dict) and isinstance(p.get("text"), str) for p in value):
        return "".join(p if isinstance(p, str) else p["text"] for p in value)
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def turns_of(record: dict, layout: Layout) -> list[tuple[str, str]]:
    """Canonical (role, text) turns; neighbouring fixed fields of one role are joined by a blank line."""
    names = dict(layout.roles)
    if layout.turns:
        first = [("system", _text(record["system"]))] if record.get("system") is not None else []
        return first + [(names.get(r := _text(t.get(layout.role)), r), _text(t.get(layout.text))) for t in record[layout.turns]]
    out: list[tuple[str, str]] = []
    for role, field in layout.fixed:
        if record.get(field) is None or field in layout.optional and record[field] == "":
            continue
        text = _text(record[field])
        if out and out[-1][0] == role:
            out[-1] = (role, f"{out[-1][1]}\n\n{text}")
        else:
            out.append((role, text))
    return out


def escape(text: str, line: bool = False) -> str:
    r"""Reversible; line also hides newlines (as ``\`` + ``n``), for roles."""
    text = _STARTS.sub(r"\1\\", text.replace("\\", "\\\\"))
    return text.replace("\n", "\\n") if line else text


def unescape(text: str, line: bool = False) -> str:
    return _ESCAPED.sub(lambda m: "\n" if line and m[1] == "n" else m[1], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """(formatted text, spans of the loss mask: the assistant's texts as they stand in it, by code points)."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role, line=True)}\n", escape(text)
        out += [head, body, END]
        at += len(head)
        if role == "assistant":
            spans.append((at, at + len(body)))
        at += len(body) + len(END)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    return [(unescape(r, line=True), unescape(t)) for r, t in _TURN.findall(formatted)]


_OUT = pa.schema([("id", pa.int64()), ("layout", pa.string()), ("fingerprint", pa.string()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def _run(layouts: tuple[Layout, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, names = registry(layouts), named(layouts)
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text in batch.column(1).to_pylist():
                try:
                    record = json.loads(text) if text else None
                except ValueError:
                    record = None
                print_ = fingerprint(field_paths(record) & names) if isinstance(record, dict) else None
                layout = known.get(print_)
                try:
                    formatted, spans = render(turns_of(record, layout)) if layout else ("", [])
                except (AttributeError, TypeError):  # the paths fit but the values are of other kinds
                    layout, formatted, spans = None, "", []
                for column, value in zip(out, (layout.name if layout else None, print_, formatted, [{"start": a, "end": b} for a, b in spans]), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *[pa.array(c, t) for c, t in zip(out, _OUT.types[1:], strict=True)]], schema=_OUT)

    return run


def format_records(records: DataFrame, id_col: str = "conv_id", record_col: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Per record: its id, layout and fingerprint, formatted, and loss (spans of formatted under the loss mask).

    A record that is null, not a JSON object, or of an unknown layout has layout null, an empty
    formatted text and no spans. A null text is empty. Repeated ids keep their rows.
    """
    small_batches(records.sparkSession, 500)
    schema = "id long, layout string, fingerprint string, formatted string, loss array<struct<start:long,end:long>>"
    return records.select(F.col(id_col).cast("long"), F.col(record_col)).mapInArrow(_run(layouts), schema).withColumnRenamed("id", id_col)


def records_of_turns(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows by turn to one JSON record of messages per conversation, in order of turn, role and text.

    Rows without an id are the turns of one conversation without an id; null roles and texts are empty.
    """
    one = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("content"))
    rows = turns.groupBy(id_col).agg(F.sort_array(F.collect_list(one)).alias("t"))
    messages = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    return rows.select(id_col, F.to_json(F.struct(messages.alias("messages"))).alias("record"))


def mixed_records(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """As records_of_turns(), but in four layouts, as a table of many sources holds them: the id picks the layout.

    A conversation of one user and one assistant turn may be a prompt and its response; one with a
    role that another layout has its own name for stays in messages. Null ids are one conversation.
    """
    one = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("content"))
    rows = turns.groupBy(id_col).agg(F.sort_array(F.collect_list(one)).alias("t"))
    sources = {name: {role: own for own, role in reversed(layout.roles)} for layout in LAYOUTS for name in (layout.name,) if layout.roles}
    taken = [own for layout in LAYOUTS for own, _ in layout.roles]

    def listed(name: str, role: str, content: str) -> Column:
        own = lambda r: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in sources.get(name, {"": ""}).items() for x in kv]), r), r)
        return F.transform("t", lambda x: F.struct(own(x["role"]).alias(role), x["content"].alias(content)))

    pair = (F.size("t") == 2) & (F.col("t")[0]["role"] == "user") & (F.get("t", F.lit(1))["role"] == "assistant")
    plain = ~F.exists("t", lambda x: x["role"].isin(taken))
    k = F.pmod(F.coalesce(F.col(id_col).cast("long"), F.lit(0)), F.lit(4))
    weighted = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"), F.lit(1.0).alias("weight")))
    record = (
        F.when(plain & (k == 1), F.to_json(F.struct(F.col(id_col).alias("id"), listed("conversations", "from", "value").alias("conversations"))))
        .when(plain & (k == 2), F.to_json(F.struct(listed("dialog", "speaker", "text").alias("dialog"))))
        .when(pair & (k == 3), F.to_json(F.struct(F.col("t")[0]["content"].alias("prompt"), F.get("t", F.lit(1))["content"].alias("response"))))
        .otherwise(F.to_json(F.struct(weighted.alias("messages"), F.lit("en").alias("lang"))))
    )
    return rows.select(id_col, record.alias("record"))


def digest(formatted: Column, loss: Column) -> Column:
    """Read back from the output: turns, their digest, the loss mask's text and its digest, the length."""

    @F.pandas_udf("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    def read_back(formatted: pd.Series, loss: pd.Series) -> pd.DataFrame:
        rows = []
        for text, spans in zip(formatted, loss, strict=True):
            turns = parse(text)
            under = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
            both = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass"))
            rows.append((len(turns), both.hexdigest(), len(under), hashlib.sha256(under.encode("utf-8", "surrogatepass")).hexdigest(), len(text)))
        return pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return read_back(formatted, loss)
