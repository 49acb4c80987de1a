"""Repair of conversation structure by weighted CYK parsing.

A conversation should read `(s?(ua)+)?`: an optional system row, then user and assistant in turn. The grammar's
nonterminals [p q] stand for rows, edited, that lead the pattern from state p to state q; its binary rules, all of
Chomsky's form [p q] -> [p r] [r q], join neighbouring spans, and its terminal rules give the edits of one row: Keep
(0), Rerole to user or assistant (1), Delete (2); an undeleted truncated row adds TRUNCATED (5). Blank and duplicate rows
can only be deleted. Every terminal cell is closed under Insert (5): empty user or assistant rows may stand before and
after the row in it, so that joined spans have them anywhere.

A cell holds, for each nonterminal, the least (cost, audit): audit is the initials of the edits, ASCII-least of the
cheapest. Cells can be joined by their least entries alone: two audits of one span and cost that differ are never each
other's beginning (the rest would be inserted rows, which cost), so what follows cannot change their order. As each pair
of states is a nonterminal, every split of a span gives the same cell, and one split is enough: cells are joined bottom-up
by span length, 1, 2, 4, ..., first inside blocks of BLOCK rows and then from block to block as Spark jobs, FAN blocks at
a time. An audit determines the repaired roles: the number of rows it leaves is even without, odd with a system row.

Rows take part in the order of turn (nulls first); rows of one turn by the first ORDERED characters of role and text, then
by a hash of both, so that repeated rows are neighbours. Null roles and texts are one space; a null conv_id is one
conversation of its own. An empty role has no initial and is never kept.

No task holds a conversation: places come from a range partitioning of short keys, duplicates from an aggregate by
digest, cells from blocks. The texts move once, to be hashed; since SHA-256 takes a conversation's rows one after the
other, they stream, sorted, through one task that holds one row and the conversation's audit. A conversation's audit
must fit into a row (2^31 edits).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from evolens.operators.joins import lookup_join
from evolens.session import materialise

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
BLOCK = 512
FAN = 16
ORDERED = 64
ROLES = {"u": "user", "a": "assistant"}
#: State reached from a state by a role: 0 nothing yet, 1 system, 2 user last, 3 assistant last.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES, ENDS = range(4), (0, 3)
FAULTS = "okay blank duplicate truncated".split()
INITIALS = "sua-"

Cell = dict[tuple[int, int], tuple[int, str]]  # nonterminal: least cost and audit


def join_cells(left: Cell, right: Cell) -> Cell:
    """[p q] -> [p r] [r q], the least of each [p q]."""
    joined: Cell = {}
    for (p, r), (cost, audit) in left.items():
        for q in STATES:
            if (r, q) in right:
                found = (cost + right[r, q][0], audit + right[r, q][1])
                if (p, q) not in joined or found < joined[p, q]:
                    joined[p, q] = found
    return joined


def _inserted() -> Cell:
    """No row, any number of inserted ones."""
    cell: Cell = {(p, p): (0, "") for p in STATES}
    step: Cell = {(p, q): (INSERT, "I") for (p, role), q in STEPS.items() if role in ROLES}
    for _ in STATES:
        longer = join_cells(cell, step)
        cell = {k: min(x for x in (cell.get(k), longer.get(k)) if x) for k in cell | longer}
    return cell


INSERTED = _inserted()


@lru_cache(maxsize=None)
def row_cell(kind: str) -> Cell:
    """The cell of one row of the given kind (see `kind_of`: 16 of them)."""
    initial, fault = INITIALS[(ord(kind) - 65) // 4], FAULTS[(ord(kind) - 65) % 4]
    edits = [((p, p), (DELETE, "D")) for p in STATES]
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED if fault == "truncated" else 0
        edits += [((p, q), (REROLE + more, "R")) for (p, role), q in STEPS.items() if role in ROLES]
        edits += [((p, q), (KEEP + more, "K")) for (p, role), q in STEPS.items() if role == initial]
    cell: Cell = {}
    for k, found in edits:
        cell[k] = min(found, cell.get(k, found))
    return join_cells(join_cells(INSERTED, cell), INSERTED)


def join_all(cells: list[Cell]) -> Cell:
    """The cell of all spans together, neighbours joined level by level."""
    while len(cells) > 1:
        cells = [join_cells(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0] if cells else INSERTED


@lru_cache(maxsize=4096)
def _short_cell(kinds: str) -> Cell:
    return join_all([row_cell(k) for k in kinds])


def span_cell(kinds: str) -> Cell:
    """The cell of a span of rows, given by their kinds; short spans are remembered, most conversations are alike."""
    return _short_cell(kinds) if len(kinds) <= 8 else join_all([_short_cell(kinds[i : i + 8]) for i in range(0, len(kinds), 8)])


def cheapest(cell: Cell) -> tuple[int, str]:
    """Cost and audit of the whole conversation with this cell."""
    return min(cell[0, q] for q in ENDS if (0, q) in cell)


def parse(kinds: str) -> tuple[int, str]:
    return cheapest(span_cell(kinds)) if kinds else (0, "")


def kind_of(initial: Column, fault: Column) -> Column:
    """One letter for each pair of initial and fault."""
    code = 4 * (F.position(initial, F.lit(INITIALS)) - 1) + fault + 65
    return F.chr(code)


def damage(rows: DataFrame) -> DataFrame:
    """The rows with `kept`, some texts and roles changed and some repeated, by crc32 of `conv_id:turn`; dropped rows stay, not `kept`."""
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = rows.select("conv_id", "turn", *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")), (F.crc32(name) % 20).alias("_hit"))
    hit = F.col("_hit")
    text = F.when(hit == 1, "").when(hit == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(hit == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (hit != 0).alias("kept"), "_hit")
    return rows.withColumn("copy", F.explode(F.when(hit == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_hit")


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds the conversation's key and what orders rows of one turn; `kept` may stand among the columns."""
    return rows.withColumns(
        {
            "_conv": F.coalesce(F.col("conv_id").cast("string"), F.lit("")),
            "_role": F.substring("role", 1, ORDERED),
            "_text": F.substring("text", 1, ORDERED),
            "_hash": F.xxhash64("role", "text"),
        }
    )


ORDER = ["turn", "_role", "_text", "_hash"]


def _placed(rows: DataFrame) -> DataFrame:
    """_conv, _place (grows with the order inside a conversation), _same (digest of role and text) and _kind of kept rows."""
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(last == "", 1).when(~last.isin(".", "!", "?"), 3).otherwise(0)
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("-")
    same = F.unhex(F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256))
    spot = F.monotonically_increasing_id()  # equal rows may be told apart in any way
    short = _keyed(rows).where("kept").select("_conv", *ORDER, spot.alias("_spot"), same.alias("_same"), kind_of(initial, fault).alias("_kind"))
    ordered = short.repartitionByRange("_conv", *ORDER, "_spot").sortWithinPartitions("_conv", *ORDER, "_spot")
    return materialise(ordered.select("_conv", F.monotonically_increasing_id().alias("_place"), "_same", "_kind"))


def _with_duplicates(placed: DataFrame) -> DataFrame:
    """Rows whose role and text occurred before are of the kind of duplicates, unless they are blank."""
    whole = (F.ascii("_kind") - 65) % 4 != 1
    groups = placed.where(whole).groupBy("_conv", "_same").agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    repeated = materialise(groups.where("_n > 1").drop("_n"))
    joined = lookup_join(placed.withColumn("_blank", ~whole), repeated, ["_conv", "_same"], "left", salt_on=["_place"])
    as_duplicate = F.chr(F.ascii("_kind") - (F.ascii("_kind") - 65) % 4 + 2)
    later = ~F.col("_blank") & (F.col("_place") > F.col("_first"))
    return joined.select("_conv", "_place", F.when(later, as_duplicate).otherwise(F.col("_kind")).alias("_kind"))


def _blocks(rows: DataFrame) -> DataFrame:
    """_conv, _block and the kinds of its rows in order, at most BLOCK of them."""
    kinds = F.array_sort(F.collect_list(F.struct("_place", "_kind")))
    block = F.floor(F.col("_place") / BLOCK).alias("_block")
    return rows.groupBy("_conv", block).agg(F.array_join(F.transform(kinds, lambda x: x["_kind"]), "").alias("kinds"))


CELL = "array<struct<p:tinyint,q:tinyint,cost:bigint,audit:string>>"
SPAN = f"_conv string, _block bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, head string, tail string, cell {CELL}"
SUMS = ("blank", "duplicate", "truncated", "illegal")


def _row_of_cell(cell: Cell) -> list[dict]:
    return [{"p": p, "q": q, "cost": cost, "audit": audit} for (p, q), (cost, audit) in sorted(cell.items())]


def _follows(left: str, right: str) -> bool:
    """Whether two neighbouring rows of these kinds have initials in an allowed order."""
    return INITIALS[(ord(left) - 65) // 4] + INITIALS[(ord(right) - 65) // 4] in ("su", "ua", "au")


def _parse_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for conv, block, kinds in zip(*(batch.column(c).to_pylist() for c in ("_conv", "_block", "kinds"))):
            faults = [(ord(k) - 65) % 4 for k in kinds]
            counts = {name: faults.count(f) for f, name in enumerate(FAULTS) if f}
            illegal = sum(not _follows(*pair) for pair in zip(kinds, kinds[1:]))
            ends = {"head": kinds[0], "tail": kinds[-1], "cell": _row_of_cell(span_cell(kinds))}
            rows.append({"_conv": conv, "_block": block, **counts, "illegal": illegal, **ends})
        yield _batch(rows)


def _join_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for conv, block, spans in zip(*(batch.column(c).to_pylist() for c in ("_conv", "_block", "spans"))):
            cells = [{(x["p"], x["q"]): (x["cost"], x["audit"]) for x in s["cell"]} for s in spans]
            sums = {name: sum(s[name] for s in spans) for name in SUMS}
            sums["illegal"] += sum(not _follows(a["tail"], b["head"]) for a, b in zip(spans, spans[1:]))
            ends = {"head": spans[0]["head"], "tail": spans[-1]["tail"], "cell": _row_of_cell(join_all(cells))}
            rows.append({"_conv": conv, "_block": block, **sums, **ends})
        yield _batch(rows)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    cell = pa.list_(pa.struct([("p", pa.int8()), ("q", pa.int8()), ("cost", pa.int64()), ("audit", pa.string())]))
    whole = [("_conv", pa.string()), *((c, pa.int64()) for c in ("_block", *SUMS)), ("head", pa.string()), ("tail", pa.string()), ("cell", cell)]
    return pa.RecordBatch.from_pylist(rows, pa.schema(whole))


def _parsed(rows: DataFrame) -> DataFrame:
    """_conv, blank, duplicate, truncated, illegal, cost and audit of every conversation with rows."""
    spans = materialise(_blocks(rows).mapInArrow(_parse_blocks, SPAN))
    parts = []
    while True:
        # Conversations in one span are done; the spans of others are numbered and joined, FAN neighbours at a time.
        counts = spans.groupBy("_conv").agg(F.count("*").alias("_n"))
        many = materialise(counts.where("_n > 1"))
        if many.isEmpty():
            parts.append(spans)
            break
        parts.append(spans.join(many, "_conv", "left_anti"))
        number = F.row_number().over(Window.partitionBy("_conv").orderBy("_block")) - 1
        group = spans.join(many.select("_conv"), "_conv").withColumn("_number", number)
        gathered = F.array_sort(F.collect_list(F.struct("_number", *SUMS, "head", "tail", "cell"))).alias("spans")
        joined = group.groupBy("_conv", F.floor(F.col("_number") / FAN).alias("_block")).agg(gathered)
        spans = materialise(joined.mapInArrow(_join_spans, SPAN))
    done = parts[0]
    for part in parts[1:]:
        done = done.unionByName(part)
    ending = F.filter("cell", lambda x: (x["p"] == 0) & x["q"].isin(*ENDS))
    best = F.array_min(F.transform(ending, lambda x: F.struct(x["cost"].alias("cost"), x["audit"].alias("audit"))))
    return done.select("_conv", *SUMS, best["cost"].alias("cost"), best["audit"].alias("audit"))


def _gaps(rows: DataFrame) -> DataFrame:
    """_conv, conv_id and gaps of every conversation, of those without kept rows as well."""
    turn = F.when(F.col("kept"), F.col("turn")).cast("decimal(38,0)")
    turns = _keyed(rows).groupBy("_conv", turn.alias("_turn")).agg(F.first("conv_id").alias("conv_id"))
    span = F.max("_turn") - F.min("_turn") + 1 - F.count("_turn")
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    return turns.groupBy("_conv").agg(F.first("conv_id").alias("conv_id"), F.least(F.coalesce(span, F.lit(0)), most).cast("bigint").alias("gaps"))


class _Repair:
    """Rows of one conversation, one after the other, edited by its audit and hashed."""

    def __init__(self, audit: str):
        self.audit, self.at, self.hash = audit, 0, hashlib.sha256()
        rows = len(audit) - audit.count("D")
        self.role, self.rows = "s" if rows % 2 else "u", 0

    def _put(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.rows else "") + f"{role}:{text}").encode())
        self.rows += 1
        self.role = "a" if self.role == "u" else "u"

    def insertions(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._put(ROLES[self.role], "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.insertions()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit != "D":
            self._put(ROLES[self.role] if edit == "R" else role, text)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each conversation: its head (a row with an audit), then its rows in order."""
    head = ["conv_id", "gaps", *SUMS, "cost", "audit"]
    current: list | None = None
    repair = _Repair("")
    for batch in batches:
        done = []
        columns = [batch.column(c).to_pylist() for c in (*head, "role", "text")]
        for *values, role, text in zip(*columns):
            if values[-1] is None:
                repair.row(role, text)
                continue
            if current is not None:
                repair.insertions()
                done.append([*current, repair.hash.hexdigest()])
            current, repair = values, _Repair(values[-1])
        yield _result(done, batch)
    if current is not None:
        repair.insertions()
        yield _result([[*current, repair.hash.hexdigest()]], batch)


def _result(rows: list[list], like: pa.RecordBatch) -> pa.RecordBatch:
    names = ["conv_id", "gaps", *SUMS, "cost", "audit", "repaired_sha256"]
    kinds = [like.schema.field("conv_id").type, *[pa.int64()] * 6, pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def repair(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, counts of faults, cost, audit and repaired_sha256 of every conversation.

    conversations: conv_id, turn, role, text, and `kept`; rows that are not kept only name their conversation. A
    conversation without kept rows has zeros, an empty audit and the hash of the empty string.
    """
    rows = conversations.select("conv_id", "turn", "role", "text", "kept")
    parsed = _parsed(_with_duplicates(_placed(rows)))
    zeros = {c: F.coalesce(c, F.lit(0)).alias(c) for c in (*SUMS, "cost")}
    heads = _gaps(rows).join(parsed, "_conv", "left").select("_conv", "conv_id", "gaps", *zeros.values(), F.coalesce("audit", F.lit("")).alias("audit"))
    texts = _keyed(rows).where("kept").select("_conv", *ORDER, "role", "text", F.lit(1).alias("_row"))
    both = heads.withColumn("_row", F.lit(0)).unionByName(texts, allowMissingColumns=True)
    streams = both.repartition("_conv").sortWithinPartitions("_conv", "_row", *ORDER)
    schema = f"conv_id {conversations.schema['conv_id'].dataType.simpleString()}, gaps bigint, " + ", ".join(f"{c} bigint" for c in (*SUMS, "cost"))
    return streams.mapInArrow(_hashed, schema + ", audit string, repaired_sha256 string")
