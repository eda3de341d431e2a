"""Repair of the turn structure of conversations by a shortest path over their rows.

Each row has a fault at most: blank, duplicate or truncated. Edits keep a row (cost 0), give it the role user or assistant (1), delete
it (2; blank and duplicate rows must go) or insert an empty user or assistant row anywhere (5); a truncated row that stays adds 5.
The repaired roles are an optional system row and then one or more pairs of user and assistant, or nothing at all. Among the cheapest
edits the one whose letters (Keep, Rerole, Delete, Insert) come first in ASCII order is taken.

Cost and letters are one integer: the cost in the high digits, below it one digit of fixed width for each letter, first letter
highest, and zeros after the last. The ordinary minimum of integers then decides both. Seen from the end, putting a letter in
front moves the others down by a digit, so a node of the graph is a row and what has been put out before it, nothing more.

Rows of a conversation pass through a task in order, sorted by Spark; a task holds a few bytes of each row of one conversation (fault
and first letter of the role, a 16-byte digest), never the texts. These come by in a second pass behind the letters of their conversation.
The integers grow with a conversation, so the time of a conversation grows with the square of its rows over 64.

Nulls in any column are one space; a null conversation or turn is a value of its own, and nulls come first. Rows of one turn are taken by
role and digest of the text. Repeated rows count as often as they come. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonecast.session import materialize

#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Letters of the audit in ASCII order; a letter's digit is its place from 1, so that the end, 0, comes before all.
LETTERS = "DIKR"
_BITS = 3
_D, _I, _K, _R = range(1, 5)
#: What has been put out: nothing, a system row, a user row, an assistant row. Roles that may follow each, by their initial.
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = {START: "su", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
STATE = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
NAMES = {"u": "user", "a": "assistant"}
SOUND, BLANK, DUPLICATE, CUT = range(4)
_NOT_SPACE = r"[^\x20\x09-\x0D]"


def cheapest(rows: list[tuple[str, int]]) -> tuple[int, str]:
    """Cost and letters of the best edits for rows of (first letter of the role, fault)."""
    if not rows:
        return 0, ""
    # deleting all rows is a way, so no better one has more inserts than that pays for; ways beyond the width cost more
    width = len(rows) + DELETE * len(rows) // INSERT
    first, above = _BITS * (width - 1), _BITS * width
    digits = (1 << above) - 1

    def before(letter: int, price: int, rest: int) -> int:
        """The weight of `rest` with a letter in front; the digit that falls off is the zero of the end."""
        return ((rest & ~digits) + (price << above)) | ((rest & digits) >> _BITS) | (letter << first)

    def least(ways: list[int]) -> int | None:
        return min(ways, default=None)

    def with_inserts(best: list[int | None]) -> list[int | None]:
        """Weights with rows put in first. After two of them a state comes back that was there before, so two rounds do."""
        for _ in range(2):
            best = [
                least([w for w in (best[s],) if w is not None] + [
                    before(_I, INSERT, best[STATE[r]]) for r in FOLLOWS[s] if r in NAMES and best[STATE[r]] is not None
                ])
                for s in range(4)
            ]
        return best

    best = with_inserts([0, None, None, 0])  # nothing, or an assistant row, may come last
    for initial, fault in reversed(rows):
        late = TRUNCATED if fault == CUT else 0
        found = []
        for s in range(4):
            ways = [] if best[s] is None else [before(_D, DELETE, best[s])]
            for role in FOLLOWS[s] if fault in (SOUND, CUT) else "":
                rest = best[STATE[role]]
                if rest is None:
                    continue
                if role == initial:
                    ways.append(before(_K, late, rest))
                if role in NAMES:
                    ways.append(before(_R, REROLE + late, rest))
            found.append(least(ways))
        best = with_inserts(found)
    weight = best[START]
    places = (weight >> (first - _BITS * at) & ((1 << _BITS) - 1) for at in range(width))
    return weight >> above, "".join(LETTERS[d - 1] for d in places if d)


class Repaired:
    """The hash of the rows that `audit` puts out, fed with the rows of a conversation one after the other."""

    def __init__(self, audit: str):
        self._audit, self._at, self._state, self._lines = audit, 0, START, 0
        self._hash = hashlib.sha256()

    def feed(self, role: str, text: str) -> None:
        self._inserts()
        letter = self._audit[self._at]
        self._at += 1
        if letter != "D":
            self._put(role if letter == "K" else None, text)

    def digest(self) -> str:
        self._inserts()
        return self._hash.hexdigest()

    def _inserts(self) -> None:
        while self._audit[self._at : self._at + 1] == "I":
            self._at += 1
            self._put(None, "")

    def _put(self, role: str | None, text: str) -> None:
        role = NAMES[FOLLOWS[self._state][-1]] if role is None else role
        self._state = STATE[role[:1]]
        self._hash.update(("\n" if self._lines else "").encode() + f"{role}:{text}".encode())
        self._lines += 1


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after the damage that the checksum of `conv_id:turn` brings; dropped rows stay, marked `gone`."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    rows = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), shown("role").alias("role"), shown("text").alias("text"), code.alias("code")
    )
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("code") == 3, 2).otherwise(1)
    return rows.select(
        "conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        (F.col("code") == 0).alias("gone"), F.explode(F.array_repeat(F.lit(0), copies)).alias("_copy"),
    ).drop("_copy")


def _ended(text: Column) -> Column:
    """Whether the last character that is no white space closes a sentence."""
    return text.rlike(r"[.!?][\x20\x09-\x0D]*\z")


def _ordered(rows: DataFrame, *first: str) -> DataFrame:
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", *first, "turn", "role", "digest")]
    return rows.repartition("conv_id").sortWithinPartitions(*order)


def _rows(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            yield from zip(*[part.column(c).to_pylist() for c in columns])


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
LEGAL = {"su", "ua", "au"}


def _batches(rows: Iterator[tuple], types: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*held), types.values())], names=list(types))

    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == 256:
            yield batch()
            held = []
    if held:
        yield batch()


def _plans(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv_id, COUNTS..., audit) of each conversation from its ordered rows."""

    def close() -> tuple:
        counts = [sum(fault == k for _, fault in kept) for k in (BLANK, DUPLICATE, CUT)]
        illegal = sum(a + b not in LEGAL for (a, _), (b, _) in zip(kept, kept[1:]))
        return current[0], last - first + 1 - turns if turns else 0, *counts, illegal, *cheapest(kept)

    current = None
    for conv, turn, initial, digest, blank, ended, gone in rows:
        if current != (conv,):
            if current:
                yield close()
            current, kept, seen, turns, first, last = (conv,), [], set(), 0, None, None
        if gone:
            continue
        if turn is not None and turn != last:
            turns, first, last = turns + 1, turn if first is None else first, turn
        kept.append((initial, BLANK if blank else DUPLICATE if digest in seen else SOUND if ended else CUT))
        seen.add(digest)
    if current:
        yield close()


def _hashes(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv_id, COUNTS..., audit, repaired_sha256): a row with an audit opens its conversation, the others are its texts."""
    plan = None
    for role, text, *row in rows:
        if row[-1] is None:
            repaired.feed(role, text)
            continue
        if plan:
            yield *plan, repaired.digest()
        plan, repaired = row, Repaired(row[-1])
    if plan:
        yield *plan, repaired.digest()


def repair(conversations: DataFrame) -> DataFrame:
    """conv_id, the counts of faults, cost, audit and hash of the repaired rows of each conversation.

    `conversations` has conv_id, turn, role and text. A conversation that loses all rows to the damage has zeros, an empty audit
    and the hash of an empty string.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    key = conversations.schema["conv_id"].dataType
    types = {"conv_id": to_arrow_type(key), **dict.fromkeys(COUNTS, pa.int64()), "audit": pa.string()}
    ddl = ", ".join([f"conv_id {key.simpleString()}", *(f"{c} long" for c in COUNTS), "audit string"])
    rows = damaged(conversations).withColumn("digest", F.unhex(F.md5(F.concat(F.length("role"), F.lit(":"), "role", "text"))))

    facts = ["conv_id", "turn", "initial", "digest", "blank", "ended", "gone"]
    compact = rows.select(
        "conv_id", "turn", "role", "digest", "gone", F.substring("role", 1, 1).alias("initial"),
        (~F.col("text").rlike(_NOT_SPACE)).alias("blank"), _ended(F.col("text")).alias("ended"),
    )
    planned = materialize(
        _ordered(compact).select(*facts).mapInArrow(lambda b: _batches(_plans(_rows(b, facts)), types), ddl), "planned"
    )

    plan = [*COUNTS, "audit"]
    heads = planned.select("*", F.lit(0).alias("part"), *[F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("digest", "binary"), ("text", "string"))])
    texts = rows.filter(~F.col("gone")).select(
        "conv_id", F.lit(1).alias("part"), "turn", "role", "digest", "text",
        *[F.lit(None).cast(planned.schema[c].dataType).alias(c) for c in plan],
    )
    wanted, with_hash = ["role", "text", "conv_id", *plan], types | {"repaired_sha256": pa.string()}
    return _ordered(heads.unionByName(texts), "part").select(*wanted).mapInArrow(
        lambda b: _batches(_hashes(_rows(b, wanted)), with_hash), f"{ddl}, repaired_sha256 string"
    )
