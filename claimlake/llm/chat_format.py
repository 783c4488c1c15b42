"""Chat records of any declared layout as one template, with a mask of what is trained on.

A record's fingerprint is the hash of its nested field paths (``messages[].role``), of those that some layout names; other fields
do not count.  Each layout declares its paths and how they become turns, and stands under the fingerprint of every choice of its optional
paths, so a record finds its mapping by one look-up.  Records whose fingerprint is unknown or that are not JSON come back with null turns,
and the fingerprint that would have to be declared.

The template puts marks around turns.  In texts, a backslash is doubled and a backslash goes after the first character of whatever
is spelled like a mark, so marks in the output are the template's own and the way back (each backslash
falls, what follows it stays) is exact.  The mask holds start and length, in code points, of each assistant text.

Rows of a conversation go to ranges of (conversation, turn), so a hot conversation is split; each task cuts its rows to pieces of ``PIECE_TURNS``
turns or ``PIECE_CHARS`` characters at most, a record each, and the formatted conversation is its pieces in order.  Reading back streams
a conversation's pieces past running hashes in one task, as a digest of a sequence needs; memory holds a piece.

Rows go by turn, null turns first, ties by role and text, repeated rows are rows each.  Null texts and null roles are empty; rows with null
ids are one conversation, and rows that bear the added conversation's id are part of it.  Extra columns are left out, an empty table gives the
added conversation alone.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

PIECE_TURNS = 256
PIECE_CHARS = 1 << 20

#: Names of roles in layouts that have their own.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant"}


@dataclass(frozen=True)
class Layout:
    """``turns``: a role with the fields of its text, joined by blank lines, or (list, role field, text field) for a turn each."""

    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple, ...]
    optional: tuple[str, ...] = ()
    roles: dict = field(default_factory=dict, hash=False)


LAYOUTS = [
    Layout("completion", ("prompt", "completion"), (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))), ("system",)),
    Layout("response", ("prompt", "response"), (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), ("system",)),
    Layout("question", ("question", "answer"), (("user", ("context", "question")), ("assistant", ("answer",))), ("context",)),
    Layout("instruction", ("instruction", "output"), (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), ("system", "input")),
    Layout("messages", ("messages[].role",), (("messages", "role", "content"),), ("messages[].content", "messages[].content[].type", "messages[].content[].text")),
    Layout("exchange", ("conversations[].from", "conversations[].value"), (("system", ("system",)), ("conversations", "from", "value")), ("system",), ROLES),
]


def field_paths(value: object, at: str = "") -> set[str]:
    """Paths of all leaves; an empty list or object is a leaf."""
    if isinstance(value, dict) and value:
        return set().union(*(field_paths(v, f"{at}.{k}" if at else k) for k, v in value.items()))
    if isinstance(value, list) and value:
        return set().union(*(field_paths(v, at + "[]") for v in value))
    return {at}


def fingerprint(paths: set[str]) -> str:
    return hashlib.blake2b("\n".join(sorted(paths)).encode(), digest_size=8).hexdigest()


@dataclass(frozen=True)
class Mappings:
    """Layouts by fingerprint, and all paths that count."""

    known: frozenset[str]
    by_print: dict[str, Layout]

    @staticmethod
    @functools.cache
    def of(layouts: tuple[Layout, ...]) -> Mappings:
        by_print: dict[str, Layout] = {}
        for layout in layouts:
            for some in itertools.chain.from_iterable(itertools.combinations(layout.optional, k) for k in range(len(layout.optional) + 1)):
                if by_print.setdefault(fingerprint({*layout.paths, *some}), layout) != layout:
                    raise ValueError(f"{layout.name} has the paths of another layout")
        return Mappings(frozenset(p for layout in layouts for p in (*layout.paths, *layout.optional)), by_print)

    def turns(self, record: str | None) -> tuple[str | None, str | None, list[tuple[str, str]] | None]:
        """Fingerprint, layout's name and turns of one record."""
        try:
            value = json.loads(record) if record is not None else None
        except ValueError:
            return None, None, None
        if not isinstance(value, dict):
            return None, None, None
        found = fingerprint(field_paths(value) & self.known)
        layout = self.by_print.get(found)
        return found, layout and layout.name, layout and list(_mapped(layout, value))


def _text(value: object) -> str:
    """A text, the texts of a message's parts, or what JSON says of anything else."""
    if isinstance(value, list):
        return "".join(_text(v.get("text")) if isinstance(v, dict) else _text(v) for v in value)
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _mapped(layout: Layout, value: dict) -> Iterator[tuple[str, str]]:
    for first, *rest in layout.turns:
        if len(rest) == 2:
            for v in value.get(first) or ():
                role = _text(v.get(rest[0]))
                yield layout.roles.get(role, role), _text(v.get(rest[1]))
        elif any(f in value for f in rest[0]):
            yield first, "\n\n".join(_text(value[f]) for f in rest[0] if f in value)


#: The template: marks before and after a turn's text; other roles are written out.
MARKS = {"user": ("[INST] ", " [/INST]\n"), "assistant": ("<s> ", " </s>\n"), "system": ("<<SYS>> ", " <</SYS>>\n")}
OTHER = ("[ROLE] ", " [/ROLE] ", " [/TURN]\n")
CONTROL = sorted({m.strip() for m in (*itertools.chain(*MARKS.values()), *OTHER)})
_ESCAPED = re.compile(r"\\|[<\[](?=" + "|".join(re.escape(c[1:]) for c in CONTROL) + ")")
_BACK = re.compile(r"\\(.)", re.S)
_TURN = re.compile("|".join([*(re.escape(a) + "(.*?)" + re.escape(b) for a, b in MARKS.values()), "(.*?)".join(map(re.escape, OTHER))]), re.S)


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m.group() + "\\", text)


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


def written(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The turns in the template, and start and length of each assistant text."""
    out, at, loss = [], 0, []
    for role, text in turns:
        before, after = MARKS.get(role) or (OTHER[0] + escape(role) + OTHER[1], OTHER[2])
        body = escape(text)
        if role == "assistant":
            loss.append((at + len(before), len(body)))
        out += [before, body, after]
        at += len(before) + len(body) + len(after)
    return "".join(out), loss


def parsed(text: str) -> Iterator[tuple[str, str]]:
    """The turns of a formatted text."""
    at, roles = 0, list(MARKS)
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        k, at = m.lastindex, m.end()
        yield (roles[k - 1], unescape(m[k])) if k <= len(roles) else (unescape(m[k - 1]), unescape(m[k]))


_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_LOSS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
_TURNS_SQL = "array<struct<role:string,text:string>>"


def canonical(records: DataFrame, record_col: str, *keep: str, layouts: tuple[Layout, ...] = tuple(LAYOUTS)) -> DataFrame:
    """``keep``, ``fingerprint``, ``layout`` and ``turns`` of JSON records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mappings = Mappings.of(layouts)
        for batch in batches:
            prints, names, turns = zip(*map(mappings.turns, batch.column(batch.num_columns - 1).to_pylist())) if batch.num_rows else ((), (), ())
            turns = [t and [{"role": r, "text": x} for r, x in t] for t in turns]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints, pa.string()), pa.array(names, pa.string()), pa.array(turns, _TURNS)], names=[*keep, "fingerprint", "layout", "turns"])

    rows = records.select(*keep, record_col)
    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {records.schema[c].dataType.simpleString()}" for c in keep), "fingerprint string, layout string", f"turns {_TURNS_SQL}"]))


def formatted(turns: DataFrame, *keep: str) -> DataFrame:
    """``keep``, ``text`` and ``loss`` (starts and lengths in code points) of rows with ``turns``; null where these are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(None, None) if t is None else written([(x["role"], x["text"]) for x in t]) for t in batch.column(batch.num_columns - 1).to_pylist()]
            loss = [spans and [{"start": a, "length": n} for a, n in spans] or (None if spans is None else []) for _, spans in out]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([t for t, _ in out], pa.string()), pa.array(loss, _LOSS)], names=[*keep, "text", "loss"])

    rows = turns.select(*keep, "turns")
    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {turns.schema[c].dataType.simpleString()}" for c in keep), "text string, loss array<struct<start:bigint,length:bigint>>"]))


def _record(turns: list[tuple[str | None, str | None]]) -> str:
    """A piece as JSON: what has the shape of a simple layout in that one, the rest as messages or an exchange."""
    roles, texts = [r or "" for r, _ in turns], [t for _, t in turns]
    if roles == ["user", "assistant"]:
        value = dict(zip(("prompt", "completion"), texts))
    elif roles == ["system", "user", "assistant"]:
        value = dict(zip(("system", "instruction", "output"), texts))
    elif set(roles) <= {"user", "assistant"} and len(roles) % 2:
        value = {"conversations": [{"from": {"user": "human", "assistant": "gpt"}[r], "value": t} for r, t in zip(roles, texts)]}
    else:
        value = {"messages": [{"role": r, "content": t} for r, t in zip(roles, texts)]}
    return json.dumps(value, ensure_ascii=False)


def _pieces(batches: Iterator[pa.RecordBatch], most_turns: int, most_chars: int) -> Iterator[pa.RecordBatch]:
    """Records of consecutive rows of a conversation."""
    part, at, key, held, chars = TaskContext.get().partitionId(), 0, None, [], 0

    def leave() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([part], pa.int64()), pa.array([at], pa.int64()), pa.array([_record(held)])], names=["conv_id", "part", "at", "record"])

    for batch in batches:
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
            if held and (conv != key or len(held) >= most_turns or chars + len(text or "") > most_chars):
                yield leave()
                at, held, chars = at + 1, [], 0
            key, chars = conv, chars + len(text or "")
            held.append((role, text))
    if held:
        yield leave()


def records_of(rows: DataFrame, piece_turns: int = PIECE_TURNS, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """``conv_id, part, at, record``: rows of (conv_id, turn, role, text) as JSON records, in order by part and at."""
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    pieces = functools.partial(_pieces, most_turns=piece_turns, most_chars=piece_chars)
    return rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(pieces, "conv_id long, part long, at long, record string")


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of each conversation, from its formatted pieces in order."""
    key = state = None

    def leave() -> pa.RecordBatch:
        n, turns, chars, loss, all_chars = state
        values = (key, n, turns.hexdigest(), chars, loss.hexdigest(), all_chars)
        return pa.RecordBatch.from_arrays([pa.array([v], pa.string() if isinstance(v, str) else pa.int64()) for v in values], names=[c.split()[0] for c in _DIGEST.split(", ")])

    for batch in batches:
        for conv, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss"))):
            if state is None or conv != key:
                if state:
                    yield leave()
                key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, said in parsed(text):
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode())
            for span in loss:
                masked = unescape(text[span["start"] : span["start"] + span["length"]])
                state[2] += len(masked)
                state[3].update(masked.encode())
            state[4] += len(text)
    if state:
        yield leave()


def read_back(pieces: DataFrame) -> DataFrame:
    """Contract columns of formatted ``conv_id, part, at, text, loss``."""
    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "at").select("conv_id", "text", "loss").mapInArrow(_read_back, _DIGEST)


ADDED = "</s>[INST] ok [/INST]"


def digest(rows: DataFrame, **pieces: int) -> DataFrame:
    """Contract columns: all conversations and conversation -1, as records of several layouts, formatted, written and read back."""
    added = rows.sparkSession.createDataFrame([(-1, 0, "user", ADDED), (-1, 1, "assistant", ADDED)], "conv_id long, turn long, role string, text string")
    records = records_of(rows.select("conv_id", "turn", "role", "text").unionByName(added), **pieces)
    key = ("conv_id", "part", "at")
    return read_back(cut(formatted(canonical(records, "record", *key), *key)))


SQL = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]', 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
  SELECT *, regexp_replace(replace(t, '\', '\\'), '([<\[])(s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\]|ROLE\]|/ROLE\]|/TURN\])', '\1\\\2', 'g') AS e,
         regexp_replace(replace(r, '\', '\\'), '([<\[])(s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\]|ROLE\]|/ROLE\]|/TURN\])', '\1\\\2', 'g') AS f
  FROM given
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)) AS turns_sha256,
       CAST(coalesce(sum(length(t)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) FILTER (r = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(e) + CASE r WHEN 'user' THEN 16 WHEN 'assistant' THEN 10 WHEN 'system' THEN 18 ELSE 26 + length(f) END) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""
