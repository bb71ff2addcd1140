"""Repair of conversations to a grammar of turns, `(s?(ua)+)?`, at least cost.

Rows are damaged by rule, then each conversation's rows stand by turn (nulls first; ties by role, then text). Faults, then
edits: keep (0), rerole (1), delete (2; required for blank and repeated rows), insert (5); a truncated row that stays adds 5.

The least cost is found in layers, as in approximate matching with bit-parallel automata: for each cost in turn, and each row, a
bitset of the grammar's states from which the rows that follow can be repaired for just that cost. The first layer in which
the start state stands before the first row gives the cost; from there the bits are followed forward, each time by the letter
that comes first (D, I, K, R), which gives the least audit. An audit determines the roles, as the grammar leaves no choice.

A conversation of at most WHOLE rows and BYTES of text is repaired at once. Longer ones are cut into stretches of at most LONG
rows, in blocks of turns that are dealt over the cluster. For each stretch the same layers give the least cost and
audit from each state to each other; two audits of a stretch with the same cost are never one the start of the other (they
spell the same rows, and an insertion costs), so the least of the whole is made of least parts, and stretches are joined up
in order, by some 16 costs each. Only SHA-256, which is sequential by definition, reads a long conversation's texts in one
task, as a stream of bounded memory. Repeated rows are found by counting (conversation, role, text digest), before.

Defined results: a null role or text is one space, as is a null conv_id or turn in the rule's key; a null conv_id is a
conversation of its own; an empty role is no known initial; repeated rows count. A conversation without rows after damage
has zeros, an empty audit and the hash of nothing. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.common import small_batches, stored, tasks, work_folder
from loomspan.sources.tables import table

BLANKS, ENDS = " \t\n\x0b\x0c\r", ".!?"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Rows and bytes of text that a conversation repaired at once may have; rows of a stretch and turns of a block of longer ones.
WHOLE, BYTES, LONG, TURNS = 1024, 8 << 20, 256, 256
#: Most bytes of names of long conversations that are broadcast.
BROADCAST_BYTES = 48 << 20
#: States: nothing yet, after system, after user, after assistant. STEP[initial][state] is the next state.
START, STATES, ACCEPT = 0, 4, 0b1001
STEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "x": {}}
ROLE = {0: "user", 1: "user", 2: "assistant", 3: "user"}


def _before(step: dict[int, int]) -> list[int]:
    """For each bitset of states, the bitset of those that step into it."""
    return [sum(1 << s for s, t in step.items() if bits >> t & 1) for bits in range(1 << STATES)]


_NEXT = {s: t for k in "ua" for s, t in STEP[k].items()}  # by a new row: from each state one role is legal
_KEPT, _MADE = {k: _before(v) for k, v in STEP.items()}, _before(_NEXT)


def layers(rows: list[tuple[str, str]], accept: int, wanted: int) -> list[list[int]]:
    """rows (initial, fault): for each cost from 0 on, for each row and the end, the states from which what follows leads to accept
    for just that cost. Ends with the layer in which all wanted states have been seen before the first row."""
    n = len(rows)
    plan = [None if fault in ("blank", "duplicate") else (_KEPT[kind], TRUNCATED if fault == "truncated" else 0) for kind, fault in rows]
    done: list[list[int]] = []
    seen, nothing = 0, [0] * (n + 1)
    get = lambda c: done[c] if c >= 0 else nothing
    for c in range(DELETE * n + 4 * INSERT + 1):
        cut, new, late = get(c - DELETE), get(c - INSERT), get(c - REROLE - TRUNCATED)
        role = get(c - REROLE)
        own = [0] * (n + 1)
        here = own[n] = (accept if c == 0 else 0) | _MADE[new[n]]
        for i in range(n - 1, -1, -1):
            bits = cut[i + 1] | _MADE[new[i]]
            if p := plan[i]:
                bits |= p[0][new[i + 1]] | _MADE[late[i + 1]] if p[1] else p[0][here] | _MADE[role[i + 1]]
            here = own[i] = bits
        done.append(own)
        seen |= here
        if seen & wanted == wanted:
            break
    return done


def trace(rows: list[tuple[str, str]], done: list[list[int]], state: int, accept: int) -> tuple[int, str] | None:
    """The least cost from state on, and of its audits the one that comes first."""
    n = len(rows)
    cost = next((c for c, layer in enumerate(done) if layer[0] >> state & 1), None)
    if cost is None:
        return None
    left, i, out = cost, 0, []
    can = lambda c, j, s: c >= 0 and s is not None and done[c][j] >> s & 1
    while not (i == n and left == 0 and accept >> state & 1):
        kind, fault = rows[i] if i < n else ("x", "blank")
        free, extra = fault not in ("blank", "duplicate"), TRUNCATED if fault == "truncated" else 0
        made = _NEXT.get(state)
        if i < n and can(left - DELETE, i + 1, state):
            letter, left, i = "D", left - DELETE, i + 1
        elif can(left - INSERT, i, made):
            letter, left, state = "I", left - INSERT, made
        elif free and can(left - extra, i + 1, STEP[kind].get(state)):
            letter, left, i, state = "K", left - extra, i + 1, STEP[kind][state]
        else:
            letter, left, i, state = "R", left - REROLE - extra, i + 1, made
        out.append(letter)
    return cost, "".join(out)


def least(rows: list[tuple[str, str]]) -> tuple[int, str]:
    """The cost and audit of a whole conversation."""
    return trace(rows, layers(rows, ACCEPT, 1 << START), START, ACCEPT)


def between(rows: list[tuple[str, str]]) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, audit) for each state and each that it can lead to."""
    reach = {0: 0b0001, 1: 0b0011, 2: 0b1111, 3: 0b1111}  # the states that can lead to a state, if need be
    kinds = {k for k, f in rows if f not in ("blank", "duplicate")}
    reach[1] = 0b0011 if "s" in kinds else 0b0010
    out = []
    for to in range(STATES):
        done = layers(rows, 1 << to, reach[to])
        out += [(s, to, *x) for s in range(STATES) if (x := trace(rows, done, s, 1 << to))]
    return out


class Repaired:
    """The hash of a conversation's rows as its audit makes them, fed in order."""

    def __init__(self):
        self.hash, self.state, self.any = hashlib.sha256(), START, False

    def _add(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
        self.any = True

    def feed(self, letter: str, role: str | None = None, text: str | None = None) -> None:
        if letter == "D":
            return
        if letter == "K":
            self._add(role, text)
            self.state = STEP[role[:1]][self.state]
        else:
            self._add(ROLE[self.state], text if letter == "R" else "")
            self.state = _NEXT[self.state]


# Rows


def damaged(turns: DataFrame, every: int = 20) -> DataFrame:
    """conv_id, turn, role, text, copies: a row that the rule drops has no copies."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % every
    text = F.when(k == 1, "").when(k == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    return turns.select("conv_id", "turn", F.when(k == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), F.when(k == 0, 0).when(k == 3, 2).otherwise(1).alias("copies"))


def marked(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, copies) with initial, fault (blank, truncated or none), digest, block, and whether the
    same role and text stand at an earlier turn."""
    seen = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(seen == "", "blank").when(~F.right(seen, F.lit(1)).isin(*ENDS), "truncated").otherwise("")
    first = F.substring("role", 1, 1)
    at = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))
    rows = rows.withColumn("fault", fault).withColumn("initial", F.when(first.isin("s", "u", "a"), first).otherwise("x")).withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))
    again = rows.where("copies > 0 AND fault <> 'blank'").groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.count("*").alias("k"), F.min(at).alias("first")).where("k > 1").drop("k")
    return rows.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left").select(
        *rows.columns, F.floor(F.col("turn") / TURNS).alias("block"), F.coalesce(at > F.col("first"), F.lit(False)).alias("again")
    )


_PART = "conv_id {0}, block long, at int, gaps long, blank long, duplicate long, truncated long, illegal long, n long, low long, high long, opening string, closing string, ways array<struct<s:int,t:int,cost:long,audit:string>>, cost long, audit string, repaired_sha256 string"


class _Stretch:
    """Rows of one conversation that stand together."""

    def __init__(self, conv, block, at: int):
        self.conv, self.block, self.at = conv, block, at
        self.rows: list[tuple[str, str]] = []
        self.said: list[tuple[str, str]] = []
        self.count = {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
        self.low = self.high = None
        self.turns = self.illegal = 0

    def add(self, kind: str, fault: str, turn: int | None, new_turn: bool) -> None:
        if self.rows and self.rows[-1][0] + kind not in ("su", "ua", "au"):
            self.illegal += 1
        self.rows.append((kind, fault))
        self.count[fault] += 1
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.turns += new_turn

    def row(self, whole: bool) -> dict:
        c, rows = self.count, self.rows
        out = {"conv_id": self.conv, "block": self.block, "at": self.at, "gaps": self.turns, "blank": c["blank"], "duplicate": c["duplicate"], "truncated": c["truncated"], "illegal": self.illegal, "n": len(rows), "low": self.low, "high": self.high}
        if not whole:
            return out | {"opening": rows[0][0] if rows else None, "closing": rows[-1][0] if rows else None, "ways": [dict(zip(("s", "t", "cost", "audit"), w)) for w in between(rows)]}
        cost, audit = least(rows)
        made, said = Repaired(), iter(self.said)
        for x in audit:
            made.feed(x, *(next(said) if x != "I" else ()))
        return out | {"gaps": 0 if self.low is None else self.high - self.low + 1 - self.turns, "cost": cost, "audit": audit, "repaired_sha256": made.hash.hexdigest()}


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def _batched(rows: Iterator[dict], schema: pa.Schema, most: int = 256) -> Iterator[pa.RecordBatch]:
    out = []
    for r in rows:
        out.append(r)
        if len(out) >= most:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def _stretches(schema: pa.Schema):
    """Of rows sorted by conversation, block, turn, role, text: a conversation that isn't long as its result, a long one as its stretches."""

    def made(rows: Iterator[tuple]) -> Iterator[dict]:
        own, whole, last = None, True, None
        for conv, block, turn, role, text, copies, kind, fault, digest, again, long in rows:
            same = own is not None and own.conv == conv and (not long or own.block == block)
            if own is not None and (not same or not whole and len(own.rows) >= LONG):
                yield own.row(whole)
            if not same:
                own, whole, last = _Stretch(conv, block, 0), not long, None
            elif not whole and len(own.rows) >= LONG:
                own = _Stretch(conv, block, own.at + 1)
            for _ in range(copies):
                here = (turn, role, digest)
                f = fault if fault == "blank" or not (again or here == last) else "duplicate"
                own.add(kind, f, turn, last is None or last[0] != turn)
                if whole:
                    own.said.append((role, text))
                last = here
        if own is not None:
            yield own.row(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(made(_rows(batches)), schema)

    return run


def _joined(schema: pa.Schema):
    """Of stretches sorted by conversation, block and number: one row for each conversation, with its least cost and audit."""

    def made(rows: Iterator[tuple]) -> Iterator[dict]:
        conv, best, sums = None, None, None

        def done() -> dict:
            cost, audit = min(best[s] for s in (0, 3) if s in best)
            out = {k: sums[k] for k in ("blank", "duplicate", "truncated", "illegal")}
            return out | {"conv_id": conv, "gaps": 0 if sums["low"] is None else sums["high"] - sums["low"] + 1 - sums["gaps"], "cost": cost, "audit": audit}

        for r in rows:
            if best is None or r["conv_id"] != conv:
                if best is not None:
                    yield done()
                conv, best = r["conv_id"], {START: (0, "")}
                sums = dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal"), 0) | {"low": None, "high": None, "closing": None}
            for k in ("gaps", "blank", "duplicate", "truncated", "illegal"):
                sums[k] += r[k]
            if r["low"] is not None:
                sums["low"], sums["high"] = r["low"] if sums["low"] is None else sums["low"], r["high"]
            if r["n"]:
                if sums["closing"] is not None and sums["closing"] + r["opening"] not in ("su", "ua", "au"):
                    sums["illegal"] += 1
                sums["closing"] = r["closing"]
                new: dict[int, tuple[int, str]] = {}
                for w in r["ways"]:
                    if w["s"] in best:
                        way = best[w["s"]][0] + w["cost"], best[w["s"]][1] + w["audit"]
                        if w["t"] not in new or way < new[w["t"]]:
                            new[w["t"]] = way
                best = new
        if best is not None:
            yield done()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(made(r for b in batches for r in b.to_pylist()), schema, 16)

    return run


def _hashed(schema: pa.Schema):
    """Of each long conversation's result, then its rows in order: the result with the hash of the repaired rows."""

    def made(rows: Iterator[tuple]) -> Iterator[dict]:
        result, now, at = None, None, 0

        def until_row() -> str | None:
            """The letter of the next row, once what stands before it is inserted; none at the end."""
            nonlocal at
            while at < len(result["audit"]):
                at += 1
                if result["audit"][at - 1] != "I":
                    return result["audit"][at - 1]
                now.feed("I")
            return None

        for found, role, text, copies in rows:
            if found is not None:
                if result is not None:
                    until_row()
                    yield result | {"repaired_sha256": now.hash.hexdigest()}
                result, now, at = found, Repaired(), 0
            else:
                for _ in range(copies):
                    now.feed(until_row(), role, text)
        if result is not None:
            until_row()
            yield result | {"repaired_sha256": now.hash.hexdigest()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(made(_rows(batches)), schema, 16)

    return run


_RESULT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def repair(rows: DataFrame, whole: int = WHOLE) -> DataFrame:
    """rows (conv_id, turn, role, text, copies): a row for each conv_id with its faults, the least cost, the least audit and the
    hash of the repaired rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark = rows.sparkSession
    small_batches(spark)
    folder, name = work_folder(spark, "turns"), rows.schema["conv_id"].dataType.simpleString()
    part = StructType.fromDDL(_PART.format(name))
    final = StructType([part[c] for c in _RESULT])
    sizes = rows.groupBy("conv_id").agg(F.sum("copies").alias("n"), F.sum(F.octet_length("text").cast("long") * F.col("copies")).alias("bytes"))
    long = stored(sizes.where((F.col("n") > whole) | (F.col("bytes") > BYTES)).select(F.col("conv_id").alias("l"), F.lit(True).alias("long")), f"{folder}/long")
    several = long.count()
    names = F.broadcast(long) if several * 64 <= BROADCAST_BYTES else long
    known = marked(rows).join(names, F.col("conv_id").eqNullSafe(F.col("l")), "left").drop("l").withColumn("long", F.coalesce("long", F.lit(False)))
    order = [F.col("conv_id"), F.col("block").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    dealt = known.repartition(tasks(spark), "conv_id", F.when(F.col("long"), F.col("block"))).sortWithinPartitions(*order)
    found = dealt.select("conv_id", "block", "turn", "role", "text", "copies", "initial", "fault", "digest", "again", "long").mapInArrow(_stretches(to_arrow_schema(part)), part)
    if not several:
        return found.select(*_RESULT)
    found = stored(found, f"{folder}/found")
    parts = found.where("ways IS NOT NULL").repartition(tasks(spark), "conv_id").sortWithinPartitions("conv_id", F.col("block").asc_nulls_first(), "at")
    results = stored(parts.mapInArrow(_joined(to_arrow_schema(final)), final), f"{folder}/joined")
    empty = StructType([final[c] for c in _RESULT]).simpleString()
    texts = known.where("long AND copies > 0").select("conv_id", F.lit(1).alias("seq"), "block", "turn", "role", "text", "copies", F.lit(None).cast(empty).alias("result"))
    heads = results.select("conv_id", F.lit(0).alias("seq"), *(F.lit(None).cast(t).alias(c) for c, t in (("block", "long"), ("turn", rows.schema["turn"].dataType.simpleString()), ("role", "string"), ("text", "string"), ("copies", "int"))), F.struct(*_RESULT).alias("result"))
    stream = heads.union(texts).repartition(tasks(spark), "conv_id").sortWithinPartitions("conv_id", "seq", *order[1:])
    return found.where("ways IS NULL").select(*_RESULT).union(stream.select("result", "role", "text", "copies").mapInArrow(_hashed(to_arrow_schema(final)), final))


def op13_turn_layers(spark: SparkSession, root: str) -> DataFrame:
    """All conversations, damaged by the rule, repaired."""
    return repair(damaged(table(spark, root, "conversations")))
