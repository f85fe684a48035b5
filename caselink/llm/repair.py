"""Repair of conversations: the cheapest edits that make the roles follow a grammar, by weighted CYK parsing.

The roles' initials of a repaired conversation are ``(s?(ua)+)?``: nothing, or a system turn if any and then user
and assistant in turn. Each row is kept (0), given the role user or assistant (3) or deleted (4), and empty turns
of user or assistant may be inserted anywhere (3). Blank and repeated rows must go; a row that breaks off costs 3
more if it stays. The audit is the initials of the edits (K, R, D, I) in order; of the cheapest repairs the one of
the least audit is taken.

The grammar in Chomsky normal form has one nonterminal for each pair (p, q) of places in the pattern: it derives
the spans of rows whose repair leads from p to q. N(p, q) -> N(p, r) N(r, q), and N(p, q) derives a row by an edit of
it. A cell of the chart holds, for each nonterminal, the least (cost, audit) of its span; insertion closure lets a
cell of one row be led and followed by inserted turns. Cells of longer spans are combined bottom-up from two
shorter ones, in spans of 1, 2, 4, ... rows. One split of a span is enough: combining is associative, as cheapest
repairs of equal cost of one span never are prefixes of one another (the longer would have insertions more, at
3 each), so that the least audit of a span is made of least audits of its parts, wherever it is split. Adding the
other splits changes no cell, which the tests check against the full chart and against trying all edits.

Rows are dealt by ranges of (conversation, turn, role, start of the text) and sorted within the partition. A task
reads them as a stream and repairs each conversation that begins and ends in its partition and holds at most
``HELD`` rows. What a range cut and longer conversations go on in blocks of ``BLOCK`` rows: first occurrences by an
aggregation, a cell for each block, the blocks' cells combined per conversation, and each block's share of the
audit back to its rows. Texts never meet in one task but as the stream of a digest; of a conversation as a whole
only its cells are held, 11 times a byte a row. Rows equal in conversation, turn, role and start of the text are
one task's, which passes them on as it reads them.

Edge cases: null role or text is one blank in ``damage`` and empty in ``repair``; null conversation ids are one
conversation; null turns come first; rows tied on the turn are ordered by role and text; a role that begins with
none of s, u, a (or is empty) cannot be kept; repeated rows are duplicates; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caselink.llm.common import run_folder, stored

REROLE, DELETE, INSERT, BROKEN_OFF = 3, 4, 3, 3
#: Rows and characters of one conversation that a task holds at once, and rows of a block of a longer one.
HELD = 4096
HELD_CHARS = 16_000_000
BLOCK = 512
_BATCH = 2048

# Places in (s?(ua)+)?: 0 start, 1 after s, 2 after u, 3 after a. It may end at 0 and 3.
_MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_ENDS = (0, 3)
_PLACES = range(4)
_SPACE = " \t\n\x0b\x0c\r"

Cell = tuple  # (cost, audit) or None for each of the 16 pairs of places


def _least(found: dict, p: int, q: int, cost: int, audit: str) -> None:
    old = found.get((p, q))
    if old is None or (cost, audit) < old:
        found[p, q] = (cost, audit)


def _cell(found: dict) -> Cell:
    return tuple(found.get((p, q)) for p in _PLACES for q in _PLACES)


# p, r, q such that the pattern leads from p over r to q.
_RULES = [
    (p, r, q)
    for p, r, q in ((p, r, q) for p in _PLACES for r in _PLACES for q in _PLACES)
    if (p == r or r > 1 or (p, r) == (0, 1)) and (r == q or q > 1 or (r, q) == (0, 1))
]
_RULES_OF = [(4 * p + q, [(4 * a + b, 4 * b + c) for a, b, c in _RULES if (a, c) == (p, q)]) for p in _PLACES for q in _PLACES]


def combine(left: Cell, right: Cell) -> Cell:
    """The cell of a span from the cells of its two parts."""
    cell = [None] * 16
    for at, splits in _RULES_OF:
        best = None
        for i, j in splits:
            a, b = left[i], right[j]
            if a is not None and b is not None:
                cost = a[0] + b[0]
                if best is None or cost < best[0]:
                    best = (cost, a[1] + b[1])
                elif cost == best[0]:
                    best = min(best, (cost, a[1] + b[1]))
        cell[at] = best
    return tuple(cell)


def _closure() -> Cell:
    """Spans without rows: nothing, or inserted turns, as few as lead from p to q."""
    found = {(p, p): (0, "") for p in _PLACES}
    for _ in _PLACES:
        for (p, r), (cost, audit) in list(found.items()):
            for (at, role), q in _MOVES.items():
                if at == r and role != "s":
                    _least(found, p, q, cost + INSERT, audit + "I")
    return _cell(found)


_NOTHING = _closure()


@lru_cache(maxsize=64)
def row_cell(kind: str) -> Cell:
    """The cell of one row. ``kind`` is its initial (x: none of the roles), in capitals if it breaks off; d: it must go."""
    found: dict = {}
    for p in _PLACES:
        _least(found, p, p, DELETE, "D")
    if kind != "d":
        extra = BROKEN_OFF if kind.isupper() else 0
        for (p, role), q in _MOVES.items():
            if role == kind.lower():
                _least(found, p, q, extra, "K")
            if role != "s":
                _least(found, p, q, REROLE + extra, "R")
    return combine(combine(_NOTHING, _cell(found)), _NOTHING)


@lru_cache(maxsize=1 << 16)
def _short(kinds: str) -> Cell:
    if len(kinds) == 1:
        return row_cell(kinds)
    half = 1 << (len(kinds) - 1).bit_length() - 1
    return combine(_short(kinds[:half]), _short(kinds[half:]))


def parse(kinds: str) -> Cell:
    """The cell of a whole span, from spans of 8 rows, then 16, 32, ..."""
    cells = [_short(kinds[i : i + 8]) for i in range(0, len(kinds), 8)] or [_NOTHING]
    return fold(cells)


def fold(cells: list[Cell]) -> Cell:
    """Neighbouring spans combined until one is left."""
    while len(cells) > 1:
        joined = [combine(a, b) for a, b in zip(cells[::2], cells[1::2])]
        cells = joined + cells[len(joined) * 2 :]
    return cells[0]


def best_end(cell: Cell) -> tuple[int, int, str]:
    """(place where the whole ends, cost, audit) of the cheapest repair."""
    cost, audit, end = min((*cell[q], q) for q in _ENDS if cell[q] is not None)
    return end, cost, audit


def replay(audit: str, rows: Iterable[tuple], place: int = 0) -> Iterator[tuple[int, str, str, str]]:
    """(number of the row it came with, edit, role, text) of every turn that the audit leaves; ``rows`` are (role, text)."""
    rows, n = iter(rows), -1
    for edit in audit:
        if edit != "I":
            n += 1
            role, text = next(rows)
            if edit == "D":
                continue
        if edit == "K":
            place = _MOVES[place, role[:1]]
            yield n, edit, role, text
        else:
            role = "assistant" if place == 2 else "user"
            place = 3 if place == 2 else 2
            yield n, edit, role, "" if edit == "I" else text


def kind_of(role: str, text: str, seen: bool) -> str:
    body = text.rstrip(_SPACE)
    if not body or seen:
        return "d"
    kind = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return kind if body[-1] in ".!?" else kind.upper()


_LEGAL = ("su", "ua", "au")


class Tally:
    """What a conversation's rows show before repair, gathered row by row."""

    def __init__(self) -> None:
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.last_turn = self.last_initial = None

    def add(self, turn: int | None, role: str, text: str, kind: str) -> None:
        if kind == "d":
            if text.strip(_SPACE):
                self.duplicate += 1
            else:
                self.blank += 1
        elif kind.isupper():
            self.truncated += 1
        if self.last_initial is not None and self.last_initial + role[:1] not in _LEGAL:
            self.illegal += 1
        self.last_initial = role[:1]
        if turn is not None:
            if turn != self.last_turn:
                self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = self.last_turn = turn

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


# One table holds what the first pass finds: 's' conversations' summaries, 'r' repaired rows, 'o' rows still open.
_FOUND = pa.schema(
    [("found", pa.string()), ("conv_id", pa.int64()), ("at", pa.int64()), ("step", pa.int64()), ("turn", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]
    + [(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    + [("audit", pa.string()), ("sha256", pa.string())]
)
_FOUND_DDL = (
    "found string, conv_id long, at long, step long, turn long, edit string, role string, text string, "
    "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, sha256 string"
)
_NAMES = _FOUND.names


def _digest(turns: Iterable[tuple[str, str]]) -> str:
    """SHA-256 of role:text, joined by line ends."""
    whole, first = hashlib.sha256(), True
    for role, text in turns:
        whole.update((f"{role}:{text}" if first else f"\n{role}:{text}").encode())
        first = False
    return whole.hexdigest()


def _close(conv_id: int | None, rows: list[tuple]) -> Iterator[dict]:
    """Summary and repaired rows of a whole conversation; ``rows`` are (at, turn, role, text)."""
    tally, seen, kinds = Tally(), set(), []
    for _, turn, role, text in rows:
        kind = kind_of(role, text, (role, text) in seen)
        seen.add((role, text))
        tally.add(turn, role, text, kind)
        kinds.append(kind)
    _, cost, audit = best_end(parse("".join(kinds)))
    left = list(replay(audit, [r[2:] for r in rows]))
    yield {
        "found": "s", "conv_id": conv_id, "gaps": tally.gaps(), "blank": tally.blank, "duplicate": tally.duplicate, "truncated": tally.truncated,
        "illegal": tally.illegal, "cost": cost, "audit": audit, "sha256": _digest((role, text) for _, _, role, text in left),
    }
    for step, (n, edit, role, text) in enumerate(left):
        row = rows[max(n, 0)]
        yield {"found": "r", "conv_id": conv_id, "at": row[0], "step": step, "turn": row[1] if edit != "I" else None, "edit": edit, "role": role, "text": text}


def _first_pass(held: int):
    """Close the conversations that lie whole in a partition; pass the rows of all others on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []

        def ready(force: bool = False) -> Iterator[pa.RecordBatch]:
            if out and (force or len(out) >= _BATCH):
                yield pa.RecordBatch.from_pylist(out, schema=_FOUND)
                out.clear()

        left_open = lambda r: {"found": "o", "conv_id": conv, "at": r[0], "turn": r[1], "role": r[2], "text": r[3]}
        # The first conversation may have begun before this partition, so it stays open.
        conv, rows, is_open, begun, chars = None, [], True, False, 0
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("conv_id", "_at", "turn", "role", "text")]
            for next_conv, *row in zip(*columns):
                if not begun or next_conv != conv:
                    if begun and not is_open:
                        out.extend(_close(conv, rows))
                    elif rows:
                        out.extend(map(left_open, rows))
                    conv, rows, is_open, begun, chars = next_conv, [], not begun, True, 0
                rows.append(row)
                chars += len(row[3])
                if len(rows) > held or chars > HELD_CHARS or (is_open and len(rows) >= _BATCH):
                    is_open = True
                    out.extend(map(left_open, rows))
                    rows, chars = [], 0
                yield from ready()
        # So may the last one go on in the next.
        out.extend(map(left_open, rows))
        yield from ready(force=True)

    return run


def _marked(rows: DataFrame, length: int) -> DataFrame:
    """Open rows with ``kind`` and ``block``; the first of equal rows of a conversation is found by an aggregation."""
    same = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))
    first = rows.groupBy("conv_id", same.alias("_same")).agg(F.min("at").alias("at")).select("at", F.lit(True).alias("_first"))
    marked = rows.join(first, "at", "left")
    body = F.rtrim(F.col("text"), F.lit(_SPACE))
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("x"))
    ends = F.substring(body, -1, 1).isin(".", "!", "?")
    kind = F.when((body == "") | F.col("_first").isNull(), F.lit("d")).when(ends, known).otherwise(F.upper(known))
    # A block lies in one partition of the order, so its rows are neighbours.
    block = F.col("at") - F.pmod(F.col("at"), F.lit(length))
    return marked.select(*[c for c in rows.columns], kind.alias("kind"), block.alias("block"))


_CELLS = "conv_id long, block long, costs array<int>, audits array<string>"


def _block_cells(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("at")
    cell = parse("".join(group["kind"]))
    row = {"conv_id": group["conv_id"].iloc[:1], "block": group["block"].iloc[:1]}
    return pd.DataFrame({**row, "costs": [[-1 if c is None else c[0] for c in cell]], "audits": [[None if c is None else c[1] for c in cell]]})


_SHARES = "conv_id long, block long, place int, audit string, cost long"


def _share_out(group: pd.DataFrame) -> pd.DataFrame:
    """Each block's place to begin at and its part of the least audit; ``cost`` is the whole conversation's."""
    group = group.sort_values("block")
    cells = [tuple(None if c < 0 else (int(c), a) for c, a in zip(*pair)) for pair in zip(group["costs"], group["audits"])]
    levels = [cells]
    while len(levels[-1]) > 1:
        last = levels[-1]
        joined = [combine(a, b) for a, b in zip(last[::2], last[1::2])]
        levels.append(joined + last[len(joined) * 2 :])
    end, cost, _ = best_end(levels[-1][0])
    wanted = [(0, end)]
    for level in reversed(levels[:-1]):
        lower = []
        for i, (p, q) in enumerate(wanted):
            pair = level[2 * i : 2 * i + 2]
            if len(pair) == 1:
                lower.append((p, q))
                continue
            a, b = pair
            options = ((a[4 * p + r][0] + b[4 * r + q][0], a[4 * p + r][1] + b[4 * r + q][1], r) for r in _PLACES if a[4 * p + r] and b[4 * r + q])
            r = min(options)[2]
            lower += [(p, r), (r, q)]
        wanted = lower
    shares = [cell[4 * p + q][1] for cell, (p, q) in zip(cells, wanted)]
    return pd.DataFrame({"conv_id": group["conv_id"].to_numpy(), "block": group["block"].to_numpy(), "place": [p for p, _ in wanted], "audit": shares, "cost": cost})


_REPAIRED = "conv_id long, at long, step long, turn long, edit string, role string, text string"


def _replay_block(rows: pd.DataFrame, share: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("at").reset_index(drop=True)
    told = list(replay(share["audit"].iloc[0], zip(rows["role"], rows["text"]), int(share["place"].iloc[0])))
    at = [max(n, 0) for n, *_ in told]
    out = pd.DataFrame(told, columns=["n", "edit", "role", "text"])
    out["conv_id"], out["at"], out["step"] = rows["conv_id"].iloc[0], rows["at"].to_numpy()[at], range(len(out))
    out["turn"] = rows["turn"].astype("Int64").take(at).to_numpy()
    out.loc[out["edit"] == "I", "turn"] = None
    return out[["conv_id", "at", "step", "turn", "edit", "role", "text"]]


def _stream_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, sha256 of rows that come by conversation and in order; holds one row at a time."""
    conv, whole, out = None, None, []
    for batch in batches:
        for next_conv, role, text in zip(*[batch.column(n).to_pylist() for n in ("conv_id", "role", "text")]):
            if whole is None or next_conv != conv:
                if whole is not None:
                    out.append((conv, whole.hexdigest()))
                conv, whole = next_conv, hashlib.sha256(f"{role}:{text}".encode())
            else:
                whole.update(f"\n{role}:{text}".encode())
    if whole is not None:
        out.append((conv, whole.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array([d for _, d in out], pa.string())], ["conv_id", "sha256"])


def _open_summaries(marked: DataFrame, shares: DataFrame, repaired: DataFrame) -> DataFrame:
    """The summary of each open conversation, by aggregations over its rows, blocks and repaired rows."""
    # Neighbours within blocks, then the ends of neighbouring blocks; a block's rows are bounded.
    initial = F.substring("role", 1, 1)
    within = W.partitionBy("conv_id", "block").orderBy("at")
    paired = marked.withColumn("initial", initial).withColumn("before", F.lag("initial").over(within)).withColumn("turn_before", F.lag("turn").over(within))
    bad = lambda a, b: a.isNotNull() & ~F.concat(a, b).isin(*_LEGAL)
    fresh = F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("turn_before"))
    n = lambda c: F.count(F.when(c, 1))
    has_text = F.rtrim(F.col("text"), F.lit(_SPACE)) != ""
    blocks = paired.groupBy("conv_id", "block").agg(
        n(~has_text).alias("blank"),
        n(has_text & (F.col("kind") == "d")).alias("duplicate"),
        n((F.col("kind") != "d") & (F.col("kind") == F.upper("kind"))).alias("truncated"),
        n(bad(F.col("before"), F.col("initial"))).alias("illegal"),
        n(fresh).alias("turns"),
        F.min("turn").alias("low"),
        F.max("turn").alias("high"),
        F.min_by("initial", "at").alias("opens"),
        F.max_by("initial", "at").alias("closes"),
        F.min_by("turn", "at").alias("first_turn"),
        F.max_by("turn", "at").alias("last_turn"),
    )
    along = W.partitionBy("conv_id").orderBy("block")
    linked = blocks.withColumn("closed", F.lag("closes").over(along)).withColumn("turn_closed", F.lag("last_turn").over(along))
    whole = linked.groupBy("conv_id").agg(
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")],
        (F.sum("illegal") + n(bad(F.col("closed"), F.col("opens")))).alias("illegal"),
        F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("turns") + n(F.col("first_turn") == F.col("turn_closed")), F.lit(0)).alias("gaps"),
    )
    audits = shares.groupBy("conv_id").agg(
        F.max("cost").alias("cost"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "audit"))), lambda s: s["audit"]), "").alias("audit"),
    )
    in_turn = repaired.select("conv_id", "at", "step", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "at", "step")
    digests = in_turn.drop("at", "step").mapInArrow(_stream_digests, "conv_id long, sha256 string")
    same = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"])
    joined = whole.join(audits, same(whole, audits)).join(digests, same(whole, digests), "left")
    return joined.select(
        whole["conv_id"], "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


_SUMMARY = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repair(turns: DataFrame, held: int = HELD, block: int = BLOCK, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(repaired, summaries) of ``turns`` (conv_id, turn, role, text).

    repaired: conv_id, at, step, turn, edit, role, text of every turn that stays or is inserted, in the order of
    (at, step) within a conversation; inserted turns have no ``turn``. summaries: one row a conversation, with its
    faults, cost, audit and the digest of its repaired turns.
    """
    folder = folder or run_folder(turns.sparkSession, "repair")
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), told("role"), told("text"))
    dealt = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64))
    ordered = dealt.sortWithinPartitions("conv_id", "turn", "role", "text").withColumn("_at", F.monotonically_increasing_id())
    found = stored(ordered.mapInArrow(_first_pass(held), _FOUND_DDL), folder, "found")
    # What ranges cut and what is long: blocks of bounded size, whatever the conversation's.
    rest = found.filter("found = 'o'").select("conv_id", "at", "turn", "role", "text")
    marked = stored(_marked(rest, block), folder, "marked")
    cells = marked.select("conv_id", "block", "at", "kind").groupBy("conv_id", "block").applyInPandas(_block_cells, _CELLS)
    shares = stored(cells.groupBy("conv_id").applyInPandas(_share_out, _SHARES), folder, "shares")
    keyed = lambda df: df.groupBy("conv_id", "block")
    replayed = stored(keyed(marked).cogroup(keyed(shares)).applyInPandas(_replay_block, _REPAIRED), folder, "replayed")
    closed = found.filter("found = 's'").select(*_SUMMARY[:-1], F.col("sha256").alias("repaired_sha256"))
    names = [f.split()[0] for f in _REPAIRED.split(", ")]
    return (
        found.filter("found = 'r'").select(*names).unionByName(replayed),
        closed.unionByName(_open_summaries(marked, shares, replayed)),
    )


def damage(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) with faults by a checksum of conversation and turn; nulls are one blank.

    Of 20 remainders 0 drops the row, 1 empties its text, 2 takes away its ``.!?``, 3 repeats it, 4 makes it the user's.
    """
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20
    text = F.when(lot == 1, F.lit("")).when(lot == 2, F.translate(told("text"), ".!?", "")).otherwise(told("text"))
    copies = F.when(lot == 0, F.lit(0)).when(lot == 3, F.lit(2)).otherwise(F.lit(1))
    return turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(lot == 4, F.lit("user")).otherwise(told("role")).alias("role"),
        text.alias("text"),
        F.explode(F.array_repeat(F.lit(True), copies)).alias("_copy"),
    ).drop("_copy")


def repaired_digests(turns: DataFrame) -> DataFrame:
    """Summaries of all conversations of ``turns`` after ``damage``; one without rows left has no faults and no edits."""
    _, summaries = repair(damage(turns))
    ids = turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().withColumnRenamed("conv_id", "_id")
    every = ids.join(summaries, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return every.select(
        F.col("_id").alias("conv_id"),
        *[zero(c) for c in _SUMMARY[1:7]],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def _plus(state: str, cost: str, letter: str, when: str = "TRUE") -> str:
    return f"{{'c': CASE WHEN {when} THEN {state}.c + {cost} ELSE 1000000000 END, 'a': {state}.a || '{letter}'}}"


def _row_step() -> str:
    """SQL of the four places' cheapest (cost, audit) after row ``k``, from those before it, ``s``."""
    extra = f"CASE WHEN k <> 'd' AND k = upper(k) THEN {BROKEN_OFF} ELSE 0 END"
    options: list[list[str]] = [[_plus(f"s[{p + 1}]", str(DELETE), "D")] for p in _PLACES]
    for (p, role), q in _MOVES.items():
        options[q].append(_plus(f"s[{p + 1}]", extra, "K", f"lower(k) = '{role}'"))
        if role != "s":
            options[q].append(_plus(f"s[{p + 1}]", f"{REROLE} + {extra}", "R", "k <> 'd'"))
    return ", ".join(f"list_min([{', '.join(o)}])" for o in options)


def _closed(states: str) -> str:
    """SQL that lets inserted turns follow: places 2 and 3 are reached from all others."""
    one = lambda i: _plus(f"n[{i}]", str(INSERT), "I")
    two = lambda i: _plus(f"n[{i}]", str(2 * INSERT), "II")
    into_2 = f"list_min([n[3], {one(1)}, {one(2)}, {one(4)}])"
    into_3 = f"list_min([n[4], {one(3)}, {two(1)}, {two(2)}])"
    return f"list_transform([[{states}]], lambda n: [n[1], n[2], {into_2}, {into_3}])[1]"


_START = ", ".join(f"{{'c': {0 if p == 0 else 10**9}, 'a': ''}}" for p in _PLACES)

SQL = rf"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t
), lots AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS lot
  FROM (SELECT *, hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))) AS h FROM conversations), crc_table
), rows AS (
  SELECT coalesce(conv_id::VARCHAR, '') AS conv, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN lot = 1 THEN '' WHEN lot = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN lot = 3 THEN 2 ELSE 1 END)) AS copy
  FROM lots WHERE lot <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, copy) AS pos, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM rows
), judged AS (
  SELECT *, body = '' AS blank, row_number() OVER (PARTITION BY conv, role, text ORDER BY pos) > 1 AS again,
    CASE WHEN substr(role, 1, 1) IN ('s', 'u', 'a') THEN substr(role, 1, 1) ELSE 'x' END AS known,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv ORDER BY pos) || substr(role, 1, 1) AS pair
  FROM placed
), kinds AS (
  SELECT *, CASE WHEN blank OR again THEN 'd' WHEN right(body, 1) IN ('.', '!', '?') THEN known ELSE upper(known) END AS kind FROM judged
), whole AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (kind = upper(kind)) AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
    list(kind ORDER BY pos) AS ks, list(role ORDER BY pos) AS roles, list(text ORDER BY pos) AS texts
  FROM kinds GROUP BY conv
), parsed AS (
  SELECT *, list_reduce(ks, lambda s, k: {_closed(_row_step())}, {_closed(_START)}) AS s FROM whole
), best AS (
  SELECT *, list_min([s[1], s[4]]) AS b FROM parsed
), replayed AS (
  SELECT *, list_reduce(string_split(b.a, ''), lambda r, e: {{
      'i': r.i + CASE WHEN e = 'I' THEN 0 ELSE 1 END,
      'p': CASE WHEN e = 'D' THEN r.p WHEN e = 'K' AND substr(roles[r.i], 1, 1) = 's' THEN 1 WHEN r.p = 2 THEN 3 ELSE 2 END,
      't': r.t || CASE WHEN e = 'D' THEN '' WHEN e = 'K' THEN chr(10) || roles[r.i] || ':' || texts[r.i]
        ELSE chr(10) || CASE WHEN r.p = 2 THEN 'assistant:' ELSE 'user:' END || CASE WHEN e = 'R' THEN texts[r.i] ELSE '' END END
    }}, {{'i': 1, 'p': 0, 't': ''}}) AS r FROM best
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(substr(r.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN replayed ON conv = coalesce(c.conv_id::VARCHAR, '')
"""
