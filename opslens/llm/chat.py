r"""Chat formatting by schema fingerprints.

The nested field paths that a record fills are hashed; the hash selects a declarative mapping that says where the turns
are. Records of any of the known layouts become the same canonical turns (conversation, turn, role, text), and turns
become pieces of one template:

    <|turn|>ROLE\nTEXT<|end|>\n

Control strings inside texts get a backslash after their first character (one more if there is one already), which
removing one backslash undoes. A piece depends on its turn alone, so formatting needs no grouping, whatever the length
of a conversation; the loss mask is a span of each assistant's piece.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

TURN, END = "<|turn|>", "<|end|>"
#: What makes `<` or `[`, with backslashes between, the start of a control string of this or of other templates.
AFTER_ANGLE, AFTER_BRACKET = r"(\||/?s>|</?SYS>>)", r"(/?INST\])"
LEARNED = "assistant"


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns. ``turns``: (role, path) pairs in order, or one (role path, text path) pair below
    ``items``; ``optional`` paths may be missing. ``roles``: names to replace."""

    name: str
    turns: tuple[tuple[str, str], ...]
    items: str = ""
    optional: tuple[str, ...] = ()
    roles: dict[str, str] = field(default_factory=dict, hash=False)

    @property
    def paths(self) -> list[str]:
        """Field paths of the layout; [] stands for the members of an array."""
        if self.items:
            return [f"{self.items}[].{p}" for p in self.turns[0]]
        return [p for _, p in self.turns]


MAPPINGS = (
    Mapping("messages", (("role", "content"),), items="messages"),
    Mapping("exchanges", (("from", "value"),), items="conversations", roles={"human": "user", "gpt": "assistant"}),
    Mapping("instruction", (("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")), optional=("system", "input")),
    Mapping("prompt and response", (("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system",)),
    Mapping("prompt and completion", (("system", "system"), ("user", "prompt"), ("assistant", "completion")), optional=("system",)),
    Mapping("question and answer", (("user", "question"), ("assistant", "answer"))),
)


def fingerprint(paths: list[str]) -> str:
    """Hash of a set of field paths."""
    return hashlib.md5("\n".join(sorted(paths)).encode()).hexdigest()


def _fingerprints(mapping: Mapping) -> list[str]:
    """Hashes of a mapping's paths with and without the optional ones."""
    fixed = [p for p in mapping.paths if p not in mapping.optional]
    return [fingerprint([*fixed, *some]) for n in range(len(mapping.optional) + 1) for some in itertools.combinations(mapping.optional, n)]


def _record_type() -> T.StructType:
    """All known fields: texts, and arrays of structs of texts."""
    arrays: dict[str, list[str]] = {}
    plain: dict[str, None] = {}
    for m in MAPPINGS:
        if m.items:
            arrays[m.items] = list(m.turns[0])
        else:
            plain.update(dict.fromkeys(m.paths))
    texts = lambda names: T.StructType([T.StructField(n, T.StringType()) for n in names])
    return T.StructType(
        [T.StructField(n, T.ArrayType(texts(f))) for n, f in arrays.items()] + [T.StructField(n, T.StringType()) for n in plain])


def _filled(record: Column) -> Column:
    """The known paths that a record fills, sorted; an array's path counts if any member fills it."""
    found = []
    for f in _record_type().fields:
        if isinstance(f.dataType, T.ArrayType):
            for inner in f.dataType.elementType.names:
                there = F.size(F.array_compact(record[f.name][inner])) > 0
                found.append(F.when(there, F.lit(f"{f.name}[].{inner}")))
        else:
            found.append(F.when(record[f.name].isNotNull(), F.lit(f.name)))
    return F.array_sort(F.array_compact(F.array(*found)))


def _turns(mapping: Mapping, record: Column) -> Column:
    """The turns of a record of a layout, as an array of (role, text)."""
    turn = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    if not mapping.items:
        given = [F.when(record[p].isNotNull(), turn(F.lit(r), record[p])) for r, p in mapping.turns]
        return F.array_compact(F.array(*given))
    role, text = mapping.turns[0]

    def named(x: Column) -> Column:
        name = x[role]
        for old, new in mapping.roles.items():
            name = F.when(x[role] == old, F.lit(new)).otherwise(name)
        return turn(name, x[text])

    return F.transform(F.array_compact(record[mapping.items]), named)


def canonical_records(records: DataFrame, record: str = "record", conv_id: str = "conv_id") -> DataFrame:
    """Turns (conv_id, turn from 0, role, text, layout) of JSON records in any known layout.

    ``layout`` is the mapping's name; records of an unknown layout, or that are no JSON objects, are kept as one row with
    null turn, role, text and layout. Unknown fields play no part. A member of a message list that lacks its role or
    its text keeps a null there.
    """
    parsed = records.select(F.col(conv_id).alias("conv_id"), F.from_json(F.col(record), _record_type()).alias("r"))
    hashed = parsed.withColumn("hash", F.md5(F.array_join(_filled(F.col("r")), "\n")))
    layout, turns = F.lit(None).cast("string"), F.lit(None)
    for m in MAPPINGS:
        mine = F.col("hash").isin(_fingerprints(m))
        layout, turns = F.when(mine, F.lit(m.name)).otherwise(layout), F.when(mine, _turns(m, F.col("r"))).otherwise(turns)
    return (
        hashed.select("conv_id", layout.alias("layout"), turns.alias("turns"))
        .select("conv_id", "layout", F.posexplode_outer("turns").alias("turn", "t"))
        .select("conv_id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text", "layout"))


#: Layouts of tables that hold one turn in each row: conversation, turn, role and text columns.
ROW_LAYOUTS = (("conv_id", "turn", "role", "text"), ("conversation_id", "turn", "role", "content"), ("dialog_id", "position", "from", "value"))


def canonical_rows(rows: DataFrame) -> DataFrame:
    """Turns of a table with a turn in each row; the hash of its columns that some layout knows selects the layout. Other
    columns play no part."""
    known = {c for layout in ROW_LAYOUTS for c in layout}
    by_hash = {fingerprint(list(layout)): layout for layout in ROW_LAYOUTS}
    own = [c for c in rows.columns if c in known]
    layout = by_hash.get(fingerprint(own)) or next((x for x in ROW_LAYOUTS if set(x) <= set(own)), None)
    if layout is None:
        raise ValueError(f"no layout known for the columns {rows.columns}")
    return rows.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(layout, ROW_LAYOUTS[0], strict=True)))


def escape(text: Column) -> Column:
    """``text`` with its control strings broken up."""
    text = F.regexp_replace(text, r"<(\\*)" + AFTER_ANGLE, r"<\\$1$2")
    return F.regexp_replace(text, r"\[(\\*)" + AFTER_BRACKET, r"[\\$1$2")


def unescape(text: str) -> str:
    """What ``escape`` was given."""
    text = re.sub(r"<\\(\\*)" + AFTER_ANGLE, r"<\1\2", text)
    return re.sub(r"\[\\(\\*)" + AFTER_BRACKET, r"[\1\2", text)


def format_turns(turns: DataFrame) -> DataFrame:
    """Each turn with its piece of the formatted conversation, and the span (loss_start, loss_chars, in code points of the
    piece) that the loss covers: the text of assistants, nothing of others.

    Null roles and texts are empty. A line feed in a role is written %0A, a percent sign %25. The formatted conversation
    is its pieces in the order of turn, role and text, nulls first; repeated turns are all kept.
    """
    role = F.replace(F.replace(F.coalesce("role", F.lit("")), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))
    head = F.concat(F.lit(TURN), escape(role), F.lit("\n"))
    body = escape(F.coalesce("text", F.lit("")))
    learned = F.col("role").eqNullSafe(LEARNED)
    return turns.select(
        "conv_id", "turn", "role", "text", F.concat(head, body, F.lit(END + "\n")).alias("piece"),
        F.when(learned, F.length(head)).otherwise(0).alias("loss_start"),
        F.when(learned, F.length(body)).otherwise(0).alias("loss_chars"))


def write(turns: DataFrame, folder: str) -> None:
    """Write the pieces (conv_id, turn, piece, loss_start, loss_chars), conversations one after the other. Ranges are cut
    at turns as well, so a conversation of any length is spread over tasks."""
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    pieces = format_turns(turns).repartitionByRange(*order).sortWithinPartitions(*order)
    pieces.select("conv_id", "turn", "piece", "loss_start", "loss_chars").write.parquet(folder)


_PIECE = re.compile(re.escape(TURN) + r"([^\n]*)\n(.*)" + re.escape(END) + r"\n", re.DOTALL)


def parse(piece: str) -> tuple[str, str]:
    """Role and text of a piece."""
    role, text = _PIECE.fullmatch(piece).groups()
    return unescape(role).replace("%0A", "\n").replace("%25", "%"), unescape(text)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in DIGEST.split(", ")]
    done, conv, state = [], (), None

    def close():
        n, turns, chars, loss, formatted = state
        done.append((conv[0], n, turns.hexdigest(), chars, loss.hexdigest(), formatted))

    def flush():
        batch = pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in done], schema=pa.schema(
            [(n, pa.string() if "sha" in n else pa.int64()) for n in names]))
        done.clear()
        return batch

    for batch in batches:
        for c, piece, start, chars in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if (c,) != conv:
                if state:
                    close()
                conv, state = (c,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, text = parse(piece)
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            learned = unescape(piece[start : start + chars])
            state[2] += len(learned)
            state[3].update(learned.encode())
            state[4] += len(piece)
        yield flush()
    if state:
        close()
    yield flush()


def digests(pieces: DataFrame) -> DataFrame:
    """A row for each conversation, read from its pieces: turns and their sha256 (role, text, a line feed after each), code
    points and sha256 of the texts under the loss mask, code points of the pieces.

    A sha256 is one sequence, so the turns of a conversation pass through one task; they stream, and are never held. A
    null conversation id is a conversation of its own.
    """
    order = ("turn", F.regexp_extract("piece", r"(?s)^<\|turn\|>([^\n]*)\n", 1), "piece")
    rows = pieces.repartition("conv_id").sortWithinPartitions("conv_id", *order)
    return rows.select("conv_id", "piece", "loss_start", "loss_chars").mapInArrow(_digests, DIGEST)
