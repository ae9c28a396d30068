"""Operator 13, conversation structure repair by a persistent audit DP.

``damage`` makes the faults, ``repair`` finds each conversation's cheapest edits.

The rows of a conversation stand by (turn, role, text digest).  A row is blank, a duplicate
(role and text seen earlier), truncated, or sound; the first sighting of a text comes from
one aggregation over (conversation, role, digest).  The sorted rows are cut into pieces of
at most PIECE rows, in range partitions, so a conversation with a third of all rows is many
tasks.  A piece is worked through for each state it may be entered in: the automaton of
``(s?(ua)+)?`` has four states, and inserts stand before the row that they precede, so a
piece ends with a row's edit.  The pieces of a conversation are then chained in order.

Both passes are the same DP.  An audit (the initials of the edits) is a node of a tree that
shares prefixes: parent, label, length, rolling hash of the whole prefix, and ancestors at
powers of two.  A node is looked up by its hash, and a hit counts only if parent and label
are the same, so equal audits are one node and a collision only costs a second entry.  Of
audits of equal cost the ASCII-least stays: the longest common prefix is searched down the
ancestors and the labels behind it decide.  At the same row and state no audit is a proper
prefix of an equally cheap one (the rest would be inserts, which cost), so the choice holds
for whatever follows.

At last the rows of a conversation stream past its audit, and the kept ones into one
SHA-256; a task holds the audit, which is the result row's own size, and one row.

Defined results: a null role or text is one space, a null conv_id or turn one space in the
damage key; null turns come first and do not count for gaps; rows of a null conv_id are one
conversation; rows of equal turn stand by role and digest of the text, repeated rows are
duplicates; a conversation without rows after damage has zeros, an empty audit and the hash
of the empty string; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tenura.llm.frames import cut_lineage, written

KEEP, REROLE, DELETE, INSERT, MEND = 0, 3, 4, 3, 3     # MEND: a truncated row that stays
PIECE = 1024
START, SYSTEM, USER, ANSWER = range(4)                 # what stands last: nothing, s, u, a
STATES = 4
FINAL = (START, ANSWER)
_SOUND, _TRUNCATED, _GONE = range(3)
_KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ANSWER, "u"): USER, (USER, "a"): ANSWER}
_NEXT = {START: USER, SYSTEM: USER, USER: ANSWER, ANSWER: USER}     # where an insert or a rerole leads
_LEGAL = {"su", "ua", "au"}
_P, _B = (1 << 61) - 1, 1_000_003


def damage(rows: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) -> the rows after damage, a repeated one twice."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key) % 20
    text = F.coalesce(F.col("text").cast("string"), space)
    return (rows.select("conv_id", F.col("turn").cast("long").alias("turn"),
                        F.coalesce(F.col("role").cast("string"), space).alias("role"), text.alias("text"), kind.alias("kind"))
            .filter("kind <> 0")
            .withColumn("text", F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", ""))
                        .otherwise(F.col("text")))
            .withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
            .withColumn("copies", F.when(F.col("kind") == 3, 2).otherwise(1))
            .select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("_"))
            .drop("_"))


class Audits:
    """Strings that share prefixes; equal strings are one node.  Node 0 is the empty string."""

    def __init__(self) -> None:
        self.label, self.length, self.hash, self.up = [""], [0], [0], [(0,)]
        self.found: dict[tuple[int, int], list[int]] = {}

    def child(self, node: int, label: str) -> int:
        h = (self.hash[node] * _B + _label_hash(label)) % _P
        same = self.found.setdefault((h, self.length[node] + 1), [])
        for x in same:
            if self.label[x] == label and self.up[x][0] == node:     # by induction: the same string
                return x
        up, at, k = [node], node, 0
        while len(self.up[at]) > k and at:
            at = self.up[at][k]
            up.append(at)
            k += 1
        self.label.append(label)
        self.length.append(self.length[node] + 1)
        self.hash.append(h)
        self.up.append(tuple(up))
        x = len(self.label) - 1
        same.append(x)
        return x

    def ancestor(self, node: int, length: int) -> int:
        step = self.length[node] - length
        while step:
            k = min(step.bit_length(), len(self.up[node])) - 1
            node = self.up[node][k]
            step = self.length[node] - length
        return node

    def less(self, x: int, y: int) -> bool:
        """Whether the string of x is the smaller; labels that differ must not be prefixes of each other."""
        if x == y:
            return False
        n = min(self.length[x], self.length[y])
        a, b = self.ancestor(x, n), self.ancestor(y, n)
        if a == b:
            return self.length[x] < self.length[y]
        k = max(len(self.up[a]), len(self.up[b]))
        while k:                                         # down to the first labels that differ
            k -= 1
            if k < len(self.up[a]) and k < len(self.up[b]) and self.up[a][k] != self.up[b][k]:
                a, b = self.up[a][k], self.up[b][k]
        return self.label[a] < self.label[b]

    def text(self, node: int, root: int = 0) -> str:
        out = []
        while node != root:
            out.append(self.label[node])
            node = self.up[node][0]
        return "".join(reversed(out))


def _label_hash(label: str) -> int:
    if len(label) == 1:
        return ord(label)
    return int.from_bytes(hashlib.blake2b(label.encode(), digest_size=7).digest(), "big") + 256


Best = list[tuple[int, int] | None]                      # per state: cost and audit


def _better(audits: Audits, old: tuple[int, int] | None, cost: int, node: int, label: str) -> tuple[int, int]:
    if old is None or cost < old[0]:
        return cost, audits.child(node, label)
    if cost > old[0]:
        return old
    new = audits.child(node, label)
    return (cost, new) if audits.less(new, old[1]) else old


def inserted(audits: Audits, best: Best) -> Best:
    """Inserts before the next row or at the end; two at most are ever worth their cost."""
    out = list(best)
    for at in (START, SYSTEM, ANSWER):
        if best[at] is not None:
            out[USER] = _better(audits, out[USER], best[at][0] + INSERT, best[at][1], "I")
    if out[USER] is not None:
        out[ANSWER] = _better(audits, out[ANSWER], out[USER][0] + INSERT, out[USER][1], "I")
    return out


def step(audits: Audits, best: Best, initial: str, fault: int) -> Best:
    """One row more."""
    best = inserted(audits, best)
    out: Best = [None] * STATES
    for at, b in enumerate(best):
        if b is None:
            continue
        cost, node = b
        out[at] = _better(audits, out[at], cost + DELETE, node, "D")
        if fault == _GONE:
            continue
        more = MEND if fault == _TRUNCATED else 0
        to = _KEPT.get((at, initial))
        if to is not None:
            out[to] = _better(audits, out[to], cost + KEEP + more, node, "K")
        to = _NEXT[at]
        out[to] = _better(audits, out[to], cost + REROLE + more, node, "R")
    return out


def final(audits: Audits, best: Best) -> tuple[int, int]:
    best = inserted(audits, best)
    ends = [best[s] for s in FINAL if best[s] is not None]
    least = ends[0]
    for cost, node in ends[1:]:
        if cost < least[0] or cost == least[0] and audits.less(node, least[1]):
            least = cost, node
    return least


_PIECES = ("conv_id {id}, turn long, role string, digest string, n long, blank long, duplicate long, truncated long, "
           "illegal long, first string, last string, t0 long, t1 long, turns long, starts array<int>, "
           "ends array<int>, costs array<long>, parts array<string>")


def _pieces():
    """Rows sorted by (conv_id, turn, role, digest) -> pieces of one conversation each."""
    names = ["conv_id", "turn", "role", "digest", "initial", "blank", "truncated", "n", "first_turn", "has_first"]

    def piece(rows: list[tuple], whole: bool):
        """whole: the conversation surely begins here, so the piece is entered at START only."""
        audits_of = [Audits() for _ in range(1 if whole else STATES)]
        bests: list[Best] = []
        for s in range(len(audits_of)):
            b: Best = [None] * STATES
            b[s] = (0, 0)
            bests.append(b)
        blank = duplicate = truncated = illegal = n = turns = 0
        t0 = t1 = before = None
        first_initial = rows[0][4]
        for conv, turn, role, digest, initial, is_blank, is_cut, is_again in rows:
            if before is not None and before + initial not in _LEGAL:
                illegal += 1
            before = initial
            if turn is not None:
                turns += turn != t1
                t0, t1 = turn if t0 is None else t0, turn
            n += 1
            blank += is_blank
            again = is_again and not is_blank
            duplicate += again
            cut = is_cut and not is_blank and not again
            truncated += cut
            fault = _GONE if is_blank or again else _TRUNCATED if cut else _SOUND
            bests = [step(a, b, initial, fault) for a, b in zip(audits_of, bests, strict=True)]
        starts, ends, costs, parts = [], [], [], []
        for s, (a, best) in enumerate(zip(audits_of, bests, strict=True)):
            for e, b in enumerate(best):
                if b is not None:
                    starts.append(s)
                    ends.append(e)
                    costs.append(b[0])
                    parts.append(a.text(b[1]))
        r = rows[0]
        return (r[0], r[1], r[2], r[3], n, blank, duplicate, truncated, illegal, first_initial, before, t0, t1, turns,
                starts, ends, costs, parts)

    def emit(out: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)],
                                          schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple] = []
        begins = False          # the piece being held is the conversation's first for sure
        schema = None
        for batch in batches:
            if schema is None:
                long, text = pa.int64(), pa.string()
                schema = pa.schema(list(zip(
                    ["conv_id", "turn", "role", "digest", "n", "blank", "duplicate", "truncated", "illegal", "first", "last",
                     "t0", "t1", "turns", "starts", "ends", "costs", "parts"],
                    [batch.schema.field("conv_id").type, long, text, text, long, long, long, long, long, text, text, long,
                     long, long, pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(long), pa.list_(text)], strict=True)))
            for conv, turn, role, digest, initial, blank, cut, n, t0, has in zip(
                    *(batch.column(c).to_pylist() for c in names), strict=True):
                again = turn != t0 if has else turn is not None       # an earlier turn had the same text
                for copy in range(n):
                    if held and (held[0][0] != conv or len(held) >= PIECE):
                        out.append(piece(held, begins))
                        begins = held[0][0] != conv
                        held = []
                    held.append((conv, turn, role, digest, initial, blank, cut, again or copy > 0))
            if len(out) >= PIECE:
                yield emit(out, schema)
                out = []
        if held:
            out.append(piece(held, begins))
        if out:
            yield emit(out, schema)
    return run


def _chained(pieces: list[dict]) -> tuple[int, str]:
    """Cost and audit of the chained pieces of one conversation, whose labels are whole parts.

    Parts of one piece end with the edit of its last row, so none is a proper prefix of another."""
    audits = Audits()
    best: Best = [None] * STATES
    best[START] = (0, 0)
    for p in pieces:
        after: Best = [None] * STATES
        for s, e, cost, part in zip(p["starts"], p["ends"], p["costs"], p["parts"], strict=True):
            if best[s] is not None:
                after[e] = _better(audits, after[e], best[s][0] + cost, best[s][1], part)
        best = after
    ends = {s: best[s] for s in range(STATES) if best[s] is not None}
    # the inserts at the end: one or two letters behind the last part
    tail = {START: [(START, "")], ANSWER: [(ANSWER, "")], USER: [(ANSWER, "I")], SYSTEM: [(ANSWER, "II")]}
    least = None
    for s, (cost, node) in ends.items():
        for _, t in tail[s]:
            total = cost + INSERT * len(t)
            if least is None or total < least[0]:
                least = total, node, t
            elif total == least[0]:
                # neither is a prefix of the other before the tails; see the module text
                if node != least[1] and audits.less(node, least[1]):
                    least = total, node, t
    return least[0], audits.text(least[1]) + least[2]


def _repaired():
    """Rows of a conversation in order, its pieces (tag 0) first: chain them, then stream the texts."""
    figures = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def chained(pieces: list[dict]) -> dict:
        out = {k: sum(p[k] for p in pieces) for k in ("blank", "duplicate", "truncated", "illegal", "turns")}
        out["illegal"] += sum(a["last"] + b["first"] not in _LEGAL for a, b in zip(pieces, pieces[1:], strict=False))
        spans = [p for p in pieces if p["t0"] is not None]
        out["turns"] -= sum(a["t1"] == b["t0"] for a, b in zip(spans, spans[1:], strict=False))
        out["gaps"] = spans[-1]["t1"] - spans[0]["t0"] + 1 - out["turns"] if spans else 0
        out["cost"], out["audit"] = _chained(pieces)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[dict] = []
        now, pieces, result = None, [], None         # conversation at hand
        kind = None

        def begin():
            nonlocal result
            result = chained(pieces) | {"conv_id": now[0], "sha": hashlib.sha256(), "at": 0, "state": START, "some": False}
            pieces.clear()

        def add(line: str):
            result["sha"].update((("\n" if result["some"] else "") + line).encode())
            result["some"] = True

        def inserts():
            audit = result["audit"]
            while result["at"] < len(audit) and audit[result["at"]] == "I":
                result["state"] = _NEXT[result["state"]]
                add("user:" if result["state"] == USER else "assistant:")
                result["at"] += 1

        def end():
            if pieces:
                begin()
            inserts()
            done.append({k: result[k] for k in ("conv_id", *figures, "audit")} | {"repaired_sha256": result["sha"].hexdigest()})

        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.schema.field("conv_id").type
            conv, tag = batch.column("conv_id").to_pylist(), batch.column("tag").to_pylist()
            place, text = batch.column("piece").to_pylist(), batch.column("text").to_pylist()
            role = batch.column("role").to_pylist()
            for c, g, p, r, t in zip(conv, tag, place, role, text, strict=True):
                if now is None or now[0] != c:
                    if now is not None:
                        end()
                    now = (c,)
                if g == 0:
                    pieces.append(p)
                    continue
                if pieces:
                    begin()
                inserts()
                edit = result["audit"][result["at"]]
                result["at"] += 1
                if edit == "D":
                    continue
                if edit == "R":
                    result["state"] = _NEXT[result["state"]]
                    r = "user" if result["state"] == USER else "assistant"
                else:
                    result["state"] = _KEPT[result["state"], r[:1]]
                add(f"{r}:{t}")
            if len(done) >= 4096:
                yield _results(done, kind, figures)
                done = []
        if now is not None:
            end()
        if done:
            yield _results(done, kind, figures)
    return run


def _results(done: list[dict], kind: pa.DataType, figures: list[str]) -> pa.RecordBatch:
    types = [kind, *[pa.int64()] * len(figures), pa.string(), pa.string()]
    names = ["conv_id", *figures, "audit", "repaired_sha256"]
    return pa.RecordBatch.from_arrays([pa.array([d[n] for d in done], t) for n, t in zip(names, types, strict=True)], names=names)


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each
    conversation of ``rows`` (conv_id, turn, role, text; role and text without nulls)."""
    words = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    rows = rows.select("conv_id", "turn", "role", "text", F.sha2("text", 256).alias("digest"),
                       (words == "").alias("blank"), (~F.right(words, F.lit(1)).isin(".", "!", "?")).alias("truncated"))
    rows = written(rows)
    key = ["conv_id", "role", "digest"]
    each = rows.groupBy(*key, "turn").agg(F.count(F.lit(1)).alias("n"), F.max("blank").alias("blank"),
                                          F.max("truncated").alias("truncated"))
    # first turn of a text; a null turn is the first of all
    first = each.groupBy(*key).agg(F.min("turn").alias("first_turn"), (F.count(F.lit(1)) == F.count("turn")).alias("has_first"))
    first = first.select(*[F.col(k).alias(f"f_{k}") for k in key], "first_turn", "has_first")
    same = F.col("conv_id").eqNullSafe(F.col("f_conv_id")) & (F.col("role") == F.col("f_role")) & (
        F.col("digest") == F.col("f_digest"))
    order = ["conv_id", "turn", "role", "digest"]
    faults = each.join(first, same).select(*order, F.left("role", F.lit(1)).alias("initial"), "blank", "truncated", "n",
                                           "first_turn", "has_first")
    kind = rows.schema["conv_id"].dataType.simpleString()
    pieces = written(faults.repartitionByRange(*order).sortWithinPartitions(*order)
                     .mapInArrow(_pieces(), _PIECES.format(id=kind)))
    own = [c for c in pieces.columns if c not in order]
    none = F.lit(None).cast(StructType([pieces.schema[c] for c in own]))
    stream = (pieces.select(*order, F.lit(0).alias("tag"), F.struct(*own).alias("piece"), F.lit(None).cast("string").alias("text"))
              .unionByName(rows.select(*order, F.lit(1).alias("tag"), none.alias("piece"), "text")))
    return (stream.repartition("conv_id").sortWithinPartitions("conv_id", "tag", "turn", "role", "digest")
            .select("conv_id", "tag", "role", "piece", "text")
            .mapInArrow(_repaired(), f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, "
                        "cost long, audit string, repaired_sha256 string"))


def repair_report(conversations: DataFrame) -> DataFrame:
    """Per original conv_id the faults and the repair of its damaged rows."""
    ids = cut_lineage(conversations.select(F.col("conv_id").alias("id")).distinct())
    fixed = repair(damage(conversations))
    long = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return (ids.join(fixed, F.col("id").eqNullSafe(F.col("conv_id")), "left")
            .select(F.col("id").alias("conv_id"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in long],
                    F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256")))
