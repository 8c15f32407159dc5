"""Repair of conversations: the cheapest edits that give roles the form system? (user assistant)+, and nothing else.

The edits of one conversation are a shortest path over four states (nothing yet, after system, after user, after
assistant). Conversations are cut into chunks wherever they lie in a range-partitioned order, so that one that holds a
third of all rows is many tasks. Costs to go are computed backwards by rank convergence: every chunk starts from a
speculative vector (that of a conversation's end), then chunks whose successor turned out to start with a vector that
isn't theirs up to a constant are run again, old and new vector side by side, until the two differ by a constant only;
passes go on until no chunk changes. Tracing goes forwards through the stitched costs: for each entry state of a chunk its
exit, the entries chained, then all chunks traced at once.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.llm.keyed import join_by_key
from corpuslens.session import discard, ensure_on_workers, materialize

NOT_BLANK = r"[^\x20\x09-\x0D]"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Rows of a chunk at most.
CHUNK = 1 << 16

# States: nothing yet, after system, after user, after assistant. NEXT is the state after a user or assistant row that
# stands where it may, USER says which of the two that is. A row's class: system, user, assistant, other.
NOTHING, SYSTEM, USER_, ASSISTANT = range(4)
NEXT = (USER_, USER_, ASSISTANT, USER_)
FITS = ({0: SYSTEM, 1: USER_}, {1: USER_}, {2: ASSISTANT}, {1: USER_})
#: Costs to go at the end of a conversation: a lone system row wants two rows, a last user row wants one.
END = (0, 2 * INSERT, INSERT, 0)
FAR_END = (1 << 63) - 1


def step_back(vector: tuple, code: int) -> tuple:
    """Costs to go before a row from those after it. code: 0 for rows that must go, else 1 + 4 * truncated + class."""
    if code == 0:
        return tuple(x + DELETE for x in vector)
    cls, extra = (code - 1) % 4, TRUNCATED * ((code - 1) // 4)
    out = []
    for s in range(4):
        best = min(DELETE + vector[s], REROLE + extra + vector[NEXT[s]])
        if cls in FITS[s]:
            best = min(best, KEEP + extra + vector[FITS[s][cls]])
        out.append(best)
    for _ in range(3):  # inserts before the row
        out = [min(x, INSERT + out[NEXT[s]]) for s, x in enumerate(out)]
    return tuple(out)


class Steps:
    """step_back() over vectors whose least cost is 0, of which there are few: each (vector, code) is worked out once."""

    def __init__(self):
        self.seen: dict[tuple, tuple] = {}

    def __call__(self, vector: tuple, code: int) -> tuple[tuple, int]:
        found = self.seen.get((vector, code))
        if found is None:
            new = step_back(vector, code)
            low = min(new)
            found = self.seen[vector, code] = (tuple(x - low for x in new), low)
        return found


def normal(vector) -> tuple:
    low = min(vector)
    return tuple(int(x - low) for x in vector)


def run_back(steps: Steps, codes: bytes, end: tuple) -> list[int]:
    """Costs to go at a chunk's start."""
    base, v = min(end), normal(end)
    for c in reversed(codes):
        v, low = steps(v, c)
        base += low
    return [base + x for x in v]


def run_again(steps: Steps, codes: bytes, old_end: tuple, old_start: list[int], end: tuple) -> list[int]:
    """The same from another end vector: both are run back until they differ by a constant, which the known start then gets."""
    a, u = min(old_end), normal(old_end)
    b, v = min(end), normal(end)
    for c in reversed(codes):
        if u == v:
            break
        u, low = steps(u, c)
        a += low
        v, low = steps(v, c)
        b += low
    if u == v:
        return [x + b - a for x in old_start]
    return [b + x for x in v]


def vectors(steps: Steps, codes: bytes, end: tuple) -> list[tuple]:
    """The normal cost vector before each row, and the end's."""
    out = [normal(end)]
    for c in reversed(codes):
        out.append(steps(out[-1], c)[0])
    out.reverse()
    return out


def trace(steps: Steps, codes: bytes, costs: list[tuple], state: int, last: bool) -> tuple[list, list, int]:
    """(edits, final inserts, state after): edits as (row, letter, new state) in order, row -1 for inserts; least letters among the cheapest.

    Rows that must go are deleted before anything is inserted, which is never dearer and the lesser audit. last: no row to be
    kept or deleted by choice follows, so what the end still wants is inserted there.
    """
    edits = []
    for i, c in enumerate(codes):
        if c == 0:
            edits.append((i, "D", state))
            continue
        after, cls, extra = costs[i + 1], (c - 1) % 4, TRUNCATED * ((c - 1) // 4)
        full = step_back(after, c)
        while True:
            here = full[state]
            if DELETE + after[state] == here:
                edits.append((i, "D", state))
                break
            if INSERT + full[NEXT[state]] == here:
                state = NEXT[state]
                edits.append((-1, "I", state))
                continue
            if cls in FITS[state] and KEEP + extra + after[FITS[state][cls]] == here:
                state = FITS[state][cls]
                edits.append((i, "K", state))
            else:
                state = NEXT[state]
                edits.append((i, "R", state))
            break
    final = []
    while last and END[state]:
        state = NEXT[state]
        final.append((-1, "I", state))
    return edits, final, state


# ---- on Spark ---------------------------------------------------------------------------------------------------


def faults(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (conv_id, turn, role, text) as two tables by row_id: texts, and the rest with fault (blank, duplicate, truncated or null: the first that holds) and code."""
    plain = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    hashed = plain.withColumns({"row_id": F.monotonically_increasing_id(), "text_hash": F.md5(F.encode("text", "utf-8")), "blank": ~F.col("text").rlike(NOT_BLANK), "cut": ~F.col("text").rlike(ENDED)})
    said = F.concat_ws(":", "text_hash", F.length("role").cast("string"), "role", F.when(F.col("conv_id").isNull(), "none").otherwise(F.concat(F.lit("id"), F.col("conv_id").cast("string"))))
    written = materialize(hashed.withColumn("said", F.unhex(F.md5(F.encode(said, "utf-8")))), "turns")
    narrow = written.select("row_id", "conv_id", "turn", "role", "text_hash", "blank", "cut", "said")
    order = F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn", "row_id"))
    again = narrow.where("not blank").groupBy("said").agg(F.count("*").alias("n"), order.alias("first")).where("n > 1")
    again = materialize(again.select("said", "n", F.col("first.row_id").alias("first_id")), "said-again")
    met = join_by_key(narrow, again, ["said"], how="left")
    fault = F.when(F.col("blank"), "blank").when(F.col("row_id") != F.col("first_id"), "duplicate").when(F.col("cut"), "truncated")
    cls = F.coalesce(F.try_element_at(F.create_map(F.lit("s"), F.lit(0), F.lit("u"), F.lit(1), F.lit("a"), F.lit(2)), F.substring("role", 1, 1)), F.lit(3))
    code = F.when(F.col("fault").isin("blank", "duplicate"), 0).otherwise(1 + F.when(F.col("fault") == "truncated", 4).otherwise(0) + cls)
    coded = met.withColumn("fault", fault).withColumn("code", code).select("row_id", "conv_id", "turn", "role", "text_hash", "fault", "code")
    return written.select("row_id", "text"), coded


def _types(schema: str):
    """The Arrow schema of a Spark schema string; made on the driver, used in tasks."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


CHUNKS = "cid long, row_ids array<long>, codes binary, choices int, start array<long>"


def chunked(coded: DataFrame, size: int) -> DataFrame:
    """(conv_id, cid, row_ids, codes, choices, start): runs of a conversation's rows in order; cid ascends in that order. start is run back from END."""
    made = f"conv_id {dict(coded.dtypes)['conv_id']}, {CHUNKS}"
    schema = _types(made)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        steps, cid = Steps(), TaskContext.get().partitionId() << 32
        conv, ids, codes, done, held = None, [], bytearray(), [], 0

        def close():
            nonlocal cid, ids, codes, held
            if ids:
                raw = bytes(codes)
                done.append({"conv_id": conv, "cid": cid, "row_ids": ids, "codes": raw, "choices": len(raw) - raw.count(0), "start": run_back(steps, raw, END)})
                cid, ids, codes, held = cid + 1, [], bytearray(), held + len(raw)

        for b in batches:
            for k, i, c in zip(*(col.to_pylist() for col in b.columns)):
                if k != conv or len(ids) >= size:
                    close()
                    conv = k
                ids.append(i)
                codes.append(c)
            if held > 4 * CHUNK:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
                done, held = [], 0
        close()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=schema)

    order = ["conv_id", "turn", "role", "text_hash", "row_id"]
    dealt = coded.select(*order, "code").repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.select("conv_id", "row_id", "code").mapInArrow(run, made)


def _map_rows(df: DataFrame, make, schema: str) -> DataFrame:
    """One small row from each small row: make(row as dict, steps) gives a tuple."""

    arrow = _types(schema)

    def run(batches):
        import pyarrow as pa

        steps = Steps()
        for b in batches:
            rows = [make(r, steps) for r in b.to_pylist()]
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r)) for r in rows], schema=arrow)

    return df.mapInArrow(run, schema)


def settled(chunks: DataFrame) -> tuple[DataFrame, int]:
    """((conv_id, cid, used), passes): the end vector, up to a constant, of each chunk of conversations in several chunks; fix-up passes it took.

    Chunks without a row to choose about leave vectors as they are and aren't in the chain. Each pass writes a few numbers a
    chunk; it makes right at least the last chunk that was wrong, and as a rule all of them.
    """
    conv = W.partitionBy("conv_id")
    chain = chunks.where("choices > 0").select("conv_id", "cid", F.lit(list(END)).cast("array<long>").alias("used"), "start")
    chain = materialize(chain.withColumn("n", F.count("*").over(conv)).where("n > 1").drop("n"), "chain")
    passes = 0
    while True:
        want = F.coalesce(F.lead("start").over(conv.orderBy("cid")), F.lit(list(END)).cast("array<long>"))
        linked = chain.withColumn("want", want).withColumn("want", F.transform("want", lambda x: x - F.array_min("want")))
        wrong = linked.where("want <> used")
        if wrong.isEmpty():
            return chain.select("conv_id", "cid", "used"), passes
        fix = lambda r, steps: (r["cid"], run_again(steps, r["codes"], tuple(r["used"]), r["start"], tuple(r["want"])))
        again = _map_rows(wrong.join(chunks.select("cid", "codes"), "cid"), fix, "cid long, fixed array<long>")
        fixed = linked.join(again, "cid", "left").select("conv_id", "cid", F.col("want").alias("used"), F.coalesce("fixed", "start").alias("start"))
        old, chain, passes = chain, materialize(fixed, "chain"), passes + 1
        discard(old)


def entries(chunks: DataFrame, ends: DataFrame) -> DataFrame:
    """(cid, entry, used, last) of the chunks in ends: the state in which the least cheapest audit enters each."""

    def exits(r, steps):
        costs = vectors(steps, r["codes"], tuple(r["used"]))
        return r["conv_id"], r["cid"], r["used"], [trace(steps, r["codes"], costs, s, False)[2] for s in range(4)]

    kind = dict(ends.dtypes)["conv_id"]
    each = _map_rows(ends.join(chunks.select("cid", "codes"), "cid"), exits, f"conv_id {kind}, cid long, used array<long>, exits array<int>")
    final = F.lead("cid").over(W.partitionBy("conv_id").orderBy("cid")).isNull()
    each = materialize(each.withColumn("last", final), "exits")

    def carry(batches):
        import pyarrow as pa

        conv, state, begun = None, NOTHING, False
        for b in batches:
            out = []
            for k, x in zip(b.column(0).to_pylist(), b.column(3).to_pylist()):
                if not begun or k != conv:
                    conv, state, begun = k, NOTHING, True
                out.append(state)
                state = x[state]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(out, pa.int32()), b.column(2), b.column(4)], names=["cid", "entry", "used", "last"])

    dealt = each.select("conv_id", "cid", "used", "exits", "last").repartition("conv_id").sortWithinPartitions("conv_id", "cid")
    return dealt.mapInArrow(carry, "cid long, entry int, used array<long>, last boolean")


def traced(chunks: DataFrame, plan: DataFrame) -> DataFrame:
    """(conv_id, chunk, step, row_id, edit, turned): every edit in order; row_id is null for inserts, turned is the role of changed and inserted rows."""
    made = f"conv_id {dict(chunks.dtypes)['conv_id']}, chunk long, step long, row_id long, edit string, turned string"
    arrow = _types(made)

    def run(batches):
        import pyarrow as pa

        steps = Steps()
        for b in batches:
            for r in b.to_pylist():
                alone = r["entry"] is None
                end, entry, last = (END, NOTHING, True) if alone else (tuple(r["used"]), r["entry"], r["last"])
                last = last and r["choices"] > 0
                edits, final, _ = trace(steps, r["codes"], vectors(steps, r["codes"], end), entry, last)
                every = edits + final
                chunk = np.full(len(every), r["cid"])
                chunk[len(edits) :] = FAR_END
                role = [("user" if s == USER_ else "assistant") if e in "RI" else None for _, e, s in every]
                rows = [None if i < 0 else r["row_ids"][i] for i, _, _ in every]
                cols = [[r["conv_id"]] * len(every), chunk, range(len(every)), rows, [e for _, e, _ in every], role]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, arrow.types)], schema=arrow)

    given = chunks.join(plan, "cid", "left").select("conv_id", "cid", "row_ids", "codes", "choices", "entry", "used", "last")
    return given.mapInArrow(run, made)


def repair(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """(conv_id, chunk, step, turn, old_role, role, text, fault, edit, cost): each conversation's edits, in the order of chunk and step.

    rows: conv_id, turn, role, text; other columns are ignored. A conversation's rows stand by turn (nulls first), then by
    role and a hash of the text. A null role or text is one space; a null conv_id is a conversation like others. Rows
    without a visible character (blank) and those whose role and text stood before in the conversation (duplicate) are
    deleted (D, cost 2). Others are kept (K), turned into user or assistant (R, 1) or deleted; truncated ones, whose last
    visible character isn't one of .!?, cost 5 more unless deleted. Rows with an empty text may be inserted (I, 5). Roles
    count by their first letter, in the form system? (user assistant)+ or nothing. Of the cheapest edits the ASCII-least
    sequence of letters is taken. Very long texts move by themselves, not with the search; an empty table gives an empty one.
    """
    ensure_on_workers(rows.sparkSession)
    texts, coded = faults(rows)
    coded = materialize(coded, "coded-turns")
    chunks = materialize(chunked(coded, size), "chunks")
    ends, _ = settled(chunks)
    edits = traced(chunks, entries(chunks, ends))
    edits = materialize(edits, "edits")
    own = coded.select("row_id", "turn", F.col("role").alias("old_role"), "fault").join(texts, "row_id")
    met = edits.where("row_id is not null").join(own, "row_id").drop("row_id")
    new = edits.where("row_id is null").drop("row_id").withColumns({"turn": F.lit(None).cast(dict(coded.dtypes)["turn"]), "old_role": F.lit(None).cast("string"), "fault": F.lit(None).cast("string"), "text": F.lit("")})
    every = met.unionByName(new)
    price = F.when(F.col("edit") == "D", DELETE).when(F.col("edit") == "I", INSERT).otherwise(F.when(F.col("edit") == "R", REROLE).otherwise(KEEP) + F.when(F.col("fault") == "truncated", TRUNCATED).otherwise(0))
    return every.select("conv_id", "chunk", "step", "turn", "old_role", F.coalesce("turned", "old_role").alias("role"), "text", "fault", "edit", price.cast("long").alias("cost"))


DIGEST = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def digest(edits: DataFrame) -> DataFrame:
    """One row a conversation: what was wrong, what the repair costs, its letters and a hash of the repaired text.

    The hash of a conversation is one chain by its nature: its rows are streamed in order through one task, which holds a
    batch of them, the letters and the state of the hash.
    """
    made = f"conv_id {dict(edits.dtypes)['conv_id']}, {DIGEST}"
    arrow = _types(made)

    def run(batches):
        import pyarrow as pa

        done, now = [], None

        def fresh(conv):
            return {"conv": conv, "low": None, "high": None, "turns": 0, "turn": None, "faults": {"blank": 0, "duplicate": 0, "truncated": 0}, "illegal": 0, "letter": None, "cost": 0, "audit": bytearray(), "hash": hashlib.sha256(), "any": False}

        def close():
            if now is not None:
                gaps = 0 if now["low"] is None else now["high"] - now["low"] + 1 - now["turns"]
                done.append((now["conv"], gaps, *now["faults"].values(), now["illegal"], now["cost"], now["audit"].decode(), now["hash"].hexdigest()))

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*done), arrow.types)], schema=arrow)

        for b in batches:
            for conv, turn, old, role, text, fault, edit, cost in zip(*(c.to_pylist() for c in b.columns)):
                if now is None or conv != now["conv"]:
                    close()
                    now = fresh(conv)
                if edit != "I":
                    if turn is not None and turn != now["turn"]:
                        now["low"] = turn if now["low"] is None else now["low"]
                        now["high"] = now["turn"] = turn
                        now["turns"] += 1
                    if fault:
                        now["faults"][fault] += 1
                    letter = old[:1]
                    if now["letter"] is not None and now["letter"] + letter not in ("su", "ua", "au"):
                        now["illegal"] += 1
                    now["letter"] = letter
                if edit != "D":
                    now["hash"].update((("\n" if now["any"] else "") + role + ":" + text).encode())
                    now["any"] = True
                now["cost"] += cost
                now["audit"] += edit.encode()
            if len(done) >= 4096:
                yield flush()
                done = []
        close()
        if done:
            yield flush()

    cols = ["turn", "old_role", "role", F.when(F.col("edit") != "D", F.col("text")).alias("text"), "fault", "edit", "cost"]
    dealt = edits.repartition("conv_id").sortWithinPartitions("conv_id", "chunk", "step")
    return dealt.select("conv_id", *cols).mapInArrow(run, made)


def damage(rows: DataFrame) -> DataFrame:
    """rows with faults put in by crc32 of conv_id:turn (nulls: one space) modulo 20: dropped, emptied, without .!?, repeated, said by the user."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.encode(F.concat(one("conv_id"), F.lit(":"), one("turn")), "utf-8")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    hit = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), fate.alias("fate")).where("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("fate") == 3, 2).otherwise(1)))
    return hit.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op13(conversations: DataFrame) -> DataFrame:
    found = digest(repair(damage(conversations))).withColumnRenamed("conv_id", "found_id")
    met = conversations.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("found_id")), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256().hexdigest()
    return met.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
