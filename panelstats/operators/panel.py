"""Panel operators: split, qualify, pivot and spread.

Column names are parameters; nothing here runs an action except explicit pivot
value discovery (a bounded distinct list).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import LABEL_REMOVE, clean_label, sorted_labels
from ..sources.io import handover


def _c(c: str | Column) -> Column:
    if isinstance(c, Column):
        return c
    return F.col("`" + c.replace("`", "``") + "`")


# -- filters ---------------------------------------------------------------

def drop_out_of_scope(df: DataFrame, id_col: str, limit: int) -> DataFrame:
    """Keep rows whose id is below ``limit`` (P1: game questions have ids >= 2000).

    A null id fails the predicate and is dropped.  Pushed into the parquet scan.
    """
    return df.where(_c(id_col) < limit)


def baseline_rows(df: DataFrame, number_col: str = "assessmentNumber") -> DataFrame:
    """Assessment number 0."""
    return df.where(_c(number_col) == 0)


def momentary_rows(df: DataFrame, number_col: str = "assessmentNumber") -> DataFrame:
    """Assessment numbers above 0 (P3); null or negative numbers are in neither split."""
    return df.where(_c(number_col) > 0)


def select_prefixed(df: DataFrame, fixed: Sequence[str], prefix: str) -> DataFrame:
    """The ``fixed`` columns followed by every other column whose name starts with ``prefix`` (P5)."""
    rest = [c for c in df.columns if c.startswith(prefix) and c not in fixed]
    return df.select([_c(c) for c in list(fixed) + rest])


def answered(df: DataFrame, column: str) -> DataFrame:
    """Rows where ``column`` holds an answer."""
    return df.where(_c(column).isNotNull())


# -- joins with a checked broadcast -----------------------------------------

def fits_broadcast(df: DataFrame, max_rows: int | None) -> bool:
    """True when ``df`` has at most ``max_rows`` rows.  Runs a count, for which
    every task sends one number (a ``limit`` would gather rows in one task)."""
    return max_rows is not None and df.count() <= max_rows


def checked_broadcast(df: DataFrame, max_rows: int | None, store: bool = False) -> DataFrame:
    """``df`` marked for broadcast when it has at most ``max_rows`` rows, else unchanged.

    Only a side whose size is proven small is broadcast, and anything larger
    is left to a shuffle join.  ``max_rows=None`` skips the check and leaves
    the choice to AQE's runtime statistics.  With ``store`` the side is
    handed over as a table before counting, so an expensive derivation (an
    aggregate over the raw table) runs once and nothing stays cached.
    """
    if max_rows is None:
        return df
    if store:
        df = handover(df, "small_side")
    return F.broadcast(df) if fits_broadcast(df, max_rows) else df


#: A key with at least this share of the rows is hot; there are at most 1 / HOT_SHARE such keys.
HOT_SHARE = 0.001


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE) -> list[str]:
    """Keys (as text) that hold at least ``share`` of the rows, by a heavy-hitter sketch.

    One scan of the key column; every task keeps a sketch of ten times as many counters as
    there can be hot keys, and the sketches are merged, so what reaches the driver is bounded
    by ``share`` alone.  The sketch's counts are over by a fifth of ``share`` at most.
    """
    most = int(-(-1 // share))
    text = _c(key).cast("string")
    got = (df.select(text.alias("k")).where(F.col("k").isNotNull())
           .agg(F.expr(f"approx_top_k(k, {most}, {10 * most})").alias("top"), F.count(F.lit(1)).alias("n")).first())
    return [] if not got["n"] else [t["item"] for t in got["top"] if t["item"] is not None and t["count"] >= share * got["n"]]


def salted_join(many: DataFrame, one: DataFrame, cond_keys: Sequence[tuple[str, str]], how: str,
                buckets: int, salt_by: Sequence[str], hot: Sequence[str] | None = None) -> DataFrame:
    """Equi-join where one key may hold a large share of ``many``'s rows.

    Rows of ``many`` whose (first) key is ``hot`` (default: found by :func:`hot_keys`) get a
    salt ``pmod(xxhash64(salt_by), buckets)``, deterministic so a retried task sees the same
    value; ``one``'s rows of a hot key (at most a few per key) are repeated once per salt.
    A hot key is then spread over ``buckets`` tasks, and the output is partitioned by (key,
    salt), so a following aggregate by the key shuffles its partial results instead of
    running the hot key in one task.  All other rows of both sides have one salt and are
    moved once.  ``how`` is ``inner`` or ``left_semi``.
    """
    left_key, right_key = cond_keys[0]
    if hot is None:
        hot = hot_keys(many, left_key)
    is_hot = lambda c: F.coalesce(_c(c).cast("string").isin(list(hot)), F.lit(False)) if hot else F.lit(False)
    salt = F.when(is_hot(left_key), F.pmod(F.xxhash64(*[_c(c) for c in salt_by]), F.lit(buckets))).otherwise(F.lit(0).cast("long"))
    salts = F.when(is_hot(right_key), F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    left = many.select("*", salt.alias("__salt"))
    right = one.select("*", F.explode(salts).alias("__salt_r"))
    cond = F.col("__salt") == F.col("__salt_r")
    for a, b in cond_keys:
        cond = cond & (left[a] == right[b])
    return left.join(right, cond, how).drop("__salt", "__salt_r")


# -- qualify participants ----------------------------------------------------

def assessments_per_participant(df: DataFrame, participant: str = "participantUUID",
                                assessment: str = "assessmentNumber",
                                out_col: str = "totalAssessments") -> DataFrame:
    """Distinct assessments per participant (A1).

    Planned as distinct (participant, assessment) with map-side partial
    aggregation, shuffled on both keys, then counted: a participant holding a
    third of all rows is spread over its assessments, not sent to one task.
    """
    return df.groupBy(participant).agg(F.countDistinct(assessment).alias(out_col))


def keep_participants(df: DataFrame, participant: str = "participantUUID",
                      assessment: str = "assessmentNumber", min_exclusive: int = 25,
                      with_count: bool = False, out_col: str = "totalAssessments",
                      broadcast_rows: int | None = None) -> DataFrame:
    """Rows of participants with more than ``min_exclusive`` distinct assessments.

    Join form, for long tables: the counts come from the skew-safe two-level
    aggregate of :func:`assessments_per_participant` and are joined back.  The
    kept-id table grows with the number of participants, so no broadcast is
    forced: AQE broadcasts it only when its measured size is below the
    threshold, and otherwise plans a sort-merge join with skew splitting.
    With ``broadcast_rows`` the kept ids are counted first and broadcast when
    at most that many, so the long table is never shuffled by participant.
    """
    kept = (assessments_per_participant(df, participant, assessment, out_col)
            .where(F.col(out_col) > min_exclusive))
    kept = checked_broadcast(kept if with_count else kept.select(participant), broadcast_rows, store=True)
    return df.join(kept, participant, "inner" if with_count else "left_semi")


def qualify_assessments(df: DataFrame, participant: str = "participantUUID",
                        assessment: str = "assessmentNumber", min_exclusive: int = 25,
                        with_count: bool = False, out_col: str = "totalAssessments") -> DataFrame:
    """Same rows as :func:`keep_participants`, computed by windows instead of a join.

    Meant for the wide table, where a participant has one row per assessment:
    one exchange on the participant, the distinct count is the highest dense
    rank of the assessment (nulls not counted), and no join exists that the
    optimizer could push below the pivot onto raw answers.
    """
    p, a = _c(participant), _c(assessment)
    byp = Window.partitionBy(p)
    ranked = df.withColumn("__rank", F.dense_rank().over(byp.orderBy(a.asc_nulls_first())))
    n = (F.max("__rank").over(byp)
         - F.max(F.when(a.isNull(), F.lit(1)).otherwise(F.lit(0))).over(byp)).cast("long")
    # A null participant never matches in the join form, so it is never kept here either.
    out = (ranked.withColumn(out_col, n).where(p.isNotNull() & (F.col(out_col) > min_exclusive))
           .drop("__rank"))
    return out if with_count else out.drop(out_col)


# -- pivots ------------------------------------------------------------------

def pivot_first(df: DataFrame, keys: Sequence[str], pivot_col: str, value_col: str,
                order: Sequence[str], values: Sequence[str] | None = None) -> DataFrame:
    """Long -> wide: per key group, one column per pivot value holding the *earliest*
    value by ``order`` (A2, A3).

    Deterministic replacement for ``first`` after a shuffle: the caller names a
    total order, and ``min_by`` picks the value at its minimum; a null order
    key sorts after every other.  Two reductions: raw rows are reduced to one
    per (keys, label) with a single ``min_by``, then the reduced rows are
    spread over the columns.  A raw row costs the same however many labels
    there are, and one key group's raw rows are split by label.  Without
    ``values`` the labels are discovered, in binary order.  Values not present
    in the data give all-null columns.
    """
    if values is None:
        values = sorted_labels(df, pivot_col)
    if not values:
        raise ValueError("pivot_first needs at least one pivot value")
    return spread_cells(answer_cells(df, keys, pivot_col, value_col, order, values), keys, values)


#: Column names of a table of cells besides its keys.
LABEL, VALUE = "__label", "__value"
#: Column of gathered cells that tells what labels their hashes stand for.
BOOK = "__book"


def answer_cells(df: DataFrame, keys: Sequence[str], pivot_col: str, value_col: str, order: Sequence[str],
                 values: Sequence[str] | None = None) -> DataFrame:
    """One row per (keys, label): the earliest value by ``order``, null order keys last.

    Labels outside ``values`` become the null label, so their key groups stay.  Shuffled on
    keys and label after map-side reduction: one key group's raw rows are split by label.
    """
    ordering = F.struct(*[x for o in order for x in (_c(o).isNull(), _c(o))])
    p = _c(pivot_col)
    label = p if values is None else F.when(p.isin(list(values)), p)
    return df.groupBy(*[_c(k).alias(k) for k in keys], label.alias(LABEL)).agg(F.min_by(_c(value_col), ordering).alias(VALUE))


def spread_cells(cells: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Cells -> wide: a column per entry of ``values``, null where a key group has no such cell.

    Each label gets its position from a dictionary (as long as the list of columns).  A key
    group's cells are gathered in order of position and become one array with nulls in the
    gaps, from which the columns are read by position: a wide row costs as much as it is
    long, however many labels there are.
    """
    spark = cells.sparkSession
    names = [f"__key{i}" for i in range(len(keys))]
    kind = cells.schema[LABEL].dataType  # values may be given as text of another type
    book = spark.createDataFrame([(str(v), i) for i, v in enumerate(values)], "__text string, __at int")
    book = F.broadcast(book.select(F.col("__text").cast(kind).alias(LABEL), "__at"))
    cell = F.when(F.col("__at").isNotNull(), F.struct("__at", VALUE))
    wide = (cells.join(book, LABEL, "left").groupBy(*[_c(k).alias(n) for k, n in zip(keys, names)])
            .agg(F.array_sort(F.collect_list(cell)).alias("__cells")))
    return _spread(wide, names, cells.schema[VALUE].dataType, len(values)).toDF(*keys, *values)


def _spread(rows: DataFrame, names: Sequence[str], kind: T.DataType, n: int) -> DataFrame:
    """``__cells`` (position, value), in order of position, as ``n`` columns."""
    gap = lambda k: F.array_repeat(F.lit(None).cast(kind), k)
    until = lambda i: F.coalesce(F.get(F.col("__cells"), i + 1)["__at"], F.lit(n))
    head = F.array(gap(F.coalesce(F.get(F.col("__cells"), F.lit(0))["__at"], F.lit(n))))
    rest = F.transform("__cells", lambda c, i: F.concat(F.array(c[VALUE]), gap(until(i) - c["__at"] - 1)))
    wide = rows.select(*names, F.flatten(F.concat(head, rest)).alias("__row"))
    return wide.select(*names, *[F.get("__row", F.lit(i)) for i in range(n)])


#: Raw rows that a task gathers at a time.
GATHER_ROWS = 100_000
#: Up to so many labels are looked up one by one, more by halving.
LABEL_SCAN = 256
#: Answers of whole assessments that a task merges: so many fit its memory and are not spilled.
MERGE_ANSWERS = 500_000
#: Of more answers than this, assessments that lie in one stretch are not moved.
MOVED_ANSWERS = 1_000_000
#: Up to so many kept participants that are too many to broadcast are told by their hashes, 8 bytes each.
HASHED_IDS = 8_000_000
#: Cells of the wide table that a task lays out at a time.
SPREAD_CELLS = 2_000_000


def _sorts_in_arrow(kind: T.DataType) -> bool:
    """True of types that Arrow orders as Spark does."""
    return isinstance(kind, (T.StringType, T.BinaryType, T.IntegralType, T.FractionalType, T.BooleanType, T.DateType,
                             T.TimestampType, T.TimestampNTZType)) and "collate" not in kind.simpleString()


def reduces(schema: T.StructType) -> bool:
    """True if :func:`gathered` reduces rows of this schema to the earliest of each label."""
    kinds = [f.dataType for f in schema.fields[schema.names.index(LABEL):]] if LABEL in schema.names else []
    return bool(kinds) and all(map(_sorts_in_arrow, kinds)) and isinstance(kinds[0], (T.StringType, T.IntegralType))


def gathered(df: DataFrame, n_keys: int, most: int = GATHER_ROWS) -> DataFrame:
    """Rows with equal values in the first ``n_keys`` columns as one row: the other columns become
    arrays of one length.

    Nothing is shuffled or sorted: a task gathers up to ``most`` of its own rows at a time (in Arrow),
    so a key's rows come in one row where they lie together, and in several where they do not.
    If the first of the other columns is ``LABEL`` (and :func:`reduces`), the arrays hold one entry per label,
    in order of label: the first by the columns after it, in their order, nulls last (a ``VALUE`` whose
    metadata has ``tie`` only breaks ties, and null is the least of them); a ``LABEL`` whose metadata has
    ``unclean`` is cleaned first as by :func:`clean_label`, each label once for all its rows.  In place of a
    label stands a hash of 8 bytes; ``BOOK`` has the labels of all rows gathered together, in the first of them.
    """
    others = df.columns[n_keys:]
    reduced = bool(others) and others[0] == LABEL and reduces(df.schema)
    tie = VALUE in others and "tie" in df.schema[VALUE].metadata
    remove = LABEL_REMOVE if reduced and "unclean" in df.schema[LABEL].metadata else None

    def differs(column):
        """Whether a value is another than the one before it; true where Arrow cannot tell."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        new = np.ones(len(column), bool)
        try:
            other = pc.not_equal(column[1:], column[:-1])
        except (pa.ArrowNotImplementedError, pa.ArrowInvalid):
            return new
        new[1:] = other.fill_null(False).to_numpy(zero_copy_only=False)
        if column.null_count:
            valid = column.is_valid().to_numpy(zero_copy_only=False)
            new[1:] |= valid[1:] != valid[:-1]
        return new

    def codes(column):
        import pyarrow as pa

        try:
            found = column.dictionary_encode(null_encoding="encode")
        except pa.ArrowNotImplementedError:  # nested keys
            found = pa.array([repr(v) for v in column.to_pylist()]).dictionary_encode()
        return found.indices.to_numpy(zero_copy_only=False).astype("int64"), found.dictionary

    def groups(keys):
        """Per row the number of its key, from 0; only the first of rows with one key in a row is looked up."""
        import numpy as np
        import pyarrow as pa

        new = np.logical_or.reduce([differs(c) for c in keys])
        starts = pa.array(np.flatnonzero(new))
        code, size = np.zeros(len(starts), np.int64), 1
        for column in keys:
            own, values = codes(column.take(starts))
            k = len(values)
            code, size = code * k + own, size * k
            if size > 1 << 31:
                values, code = np.unique(code, return_inverse=True)
                size = len(values)
        values, code = np.unique(code, return_inverse=True)
        return code[np.cumsum(new) - 1], len(values)

    def firsts(label, columns, group):
        """Rows to keep, in order of group and label, the hashes of their labels, and what these stand for."""
        import hashlib

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        code, values = codes(label)
        if remove:
            again, values = codes(pc.replace_substring_regex(values, remove, ""))
            code = again[code]
        order = pc.array_sort_indices(values)
        rank = np.empty(len(values), np.int64)
        rank[order.to_numpy()] = np.arange(len(values))
        code, values = rank[code], values.take(order)
        cell = group * len(values) + code
        order = np.argsort(cell, kind="stable")
        cell = cell[order]
        again = np.append(False, cell[1:] == cell[:-1])
        if again.any():
            tied = again | np.append(again[1:], False)
            rows = pa.array(order[tied])
            keys = {"cell": pa.array(cell[tied])}
            for name, column in columns.items():
                column = column.take(rows)
                if name == VALUE and tie:
                    keys["valid"] = column.is_valid().cast(pa.int8())
                keys[name] = column.cast(pa.int8()) if pa.types.is_boolean(column.type) else column
            order[tied] = rows.take(pc.sort_indices(pa.table(keys), sort_keys=[(k, "ascending") for k in keys], null_placement="at_end"))
        order = order[~again]
        texts = values.cast(pa.string())
        hashed = pa.array([None if v is None else int.from_bytes(hashlib.md5(v.encode()).digest()[:8], "little", signed=True)
                           for v in texts.to_pylist()], pa.int64())
        return order, hashed.take(pa.array(code[order])), pa.StructArray.from_arrays([hashed, texts], ["hash", "label"])

    def merged(batches):
        import numpy as np
        import pyarrow as pa

        whole = pa.Table.from_batches(batches)
        columns = [pa.concat_arrays(c.chunks) for c in whole.columns]
        group, n = groups(columns[:n_keys])
        if reduced:
            order, labels, book = firsts(columns[n_keys], dict(zip(others[1:], columns[n_keys + 1:])), group)
        else:
            order, labels = np.argsort(group, kind="stable"), None
        ends = np.append(0, np.cumsum(np.bincount(group[order], minlength=n)))
        first, order = pa.array(order[ends[:-1]]), pa.array(order)
        ends = pa.array(ends.astype(np.int32))
        taken = [c.take(order) if labels is None or i else labels for i, c in enumerate(columns[n_keys:])]
        out = [c.take(first) for c in columns[:n_keys]] + [pa.ListArray.from_arrays(ends, c) for c in taken]
        if reduced:
            out.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.full(n, len(book))).astype(np.int32)), book))
        return pa.RecordBatch.from_arrays(out, names=[f.name for f in fields])

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= most:
                yield merged(held)
                held, rows = [], 0
        if rows:
            yield merged(held)

    fields = [T.StructField(f.name, f.dataType if i < n_keys else T.ArrayType(T.LongType() if reduced and i == n_keys else f.dataType))
              for i, f in enumerate(df.schema.fields)]
    if reduced:
        entry = T.StructType([T.StructField("hash", T.LongType()), T.StructField("label", T.StringType())])
        fields.append(T.StructField(BOOK, T.ArrayType(entry)))
    return df.mapInArrow(run, T.StructType(fields))


def _earliest(cells: DataFrame, names: Sequence[str], by: Sequence[str], where: Column | None = None) -> DataFrame:
    """``__cells`` (label, ``by``, value) reduced to the first by ``by`` of each label, in order of label;
    rows outside ``where`` stay as they are."""
    plain = [LABEL, *[o for o in by if o != VALUE], VALUE]
    cell = lambda c: F.struct(c[LABEL].alias(LABEL), *[x.alias(f"{n}{o}") for o in by for n, x in (("null", c[o].isNull()), ("", c[o]))],
                              *[c[VALUE].alias(VALUE)] * (VALUE not in by))
    only = (lambda c: c) if where is None else lambda c: F.when(where, c)
    ordered = cells.withColumn("__ordered", only(F.array_sort(F.transform("__cells", cell))))
    is_first = lambda c, i: (i == 0) | ~c[LABEL].eqNullSafe(F.get(F.col("__ordered"), i - 1)[LABEL])
    first = F.transform(F.filter("__ordered", is_first), lambda c: F.struct(*[c[p].alias(p) for p in plain]))
    return ordered.select(*names, (first if where is None else only(first).otherwise(F.col("__cells"))).alias("__cells"))


def _position(label: Column, labels: Sequence[str], kind: T.DataType) -> Column:
    """Place of ``label`` in ``labels``, which are in order and hold it; null of null."""
    if not labels:
        return F.lit(None).cast("int")
    book = F.array(*[F.lit(v).cast(kind) for v in labels])
    if len(labels) <= LABEL_SCAN or not isinstance(kind, T.StringType):
        return F.array_position(book, label).cast("int") - 1
    steps = F.array(*[F.lit(1 << k) for k in range(len(labels).bit_length() - 1, -1, -1)])
    upto = F.aggregate(steps, F.lit(-1), lambda at, s: at + F.when(F.get(book, at + s) <= label, s).otherwise(0))
    return F.when(label.isNotNull(), upto)


def _hashes_of_kept(counts: DataFrame, who: str, most: int):
    """The sorted hashes of the participants marked ``kept``, or None where they are more than ``most``,
    are of a type whose equal values may hash apart, or one is the hash of another participant as well."""
    import numpy as np

    kind = counts.schema[who].dataType
    if "collate" in kind.simpleString() or not isinstance(kind, (T.StringType, T.IntegralType, T.DateType, T.TimestampType)):
        return None
    if not fits_broadcast(counts.where("kept"), most):
        return None
    found = (counts.where(F.col(who).isNotNull()).groupBy(F.xxhash64(who).alias("hash"))
             .agg(F.bool_or("kept").alias("some"), F.bool_and("kept").alias("every")).where("some").select("hash", "every").toArrow())
    if not found["every"].to_numpy().all():
        return None
    return np.sort(found["hash"].to_numpy())


def _only(hashes):
    """Of a batch the rows whose ``__who`` is among the sorted ``hashes``; all of them where there are none."""
    def only(batch):
        import numpy as np
        import pyarrow as pa

        if hashes is None:
            return batch
        if not len(hashes):
            return batch.slice(0, 0)
        who = batch.column("__who").to_numpy()
        at = np.minimum(np.searchsorted(hashes, who), len(hashes) - 1)
        return batch.filter(pa.array(hashes[at] == who))

    return only


def _labels_in(rows: DataFrame, hashes=None) -> DataFrame:
    """The labels of ``rows``, each at least once: a task tells those of its rows."""
    only = _only(hashes)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        held = None
        for batch in batches:
            found = pc.unique(only(batch).column(LABEL).flatten())
            held = found if held is None else pc.unique(pa.concat_arrays([held, found]))
            if len(held) > GATHER_ROWS:
                yield pa.RecordBatch.from_arrays([held], [LABEL])
                held = None
        if held is not None:
            yield pa.RecordBatch.from_arrays([held], [LABEL])

    own = [F.xxhash64(rows["__who"]).alias("__who")] if hashes is not None else []
    return rows.select(*own, LABEL).mapInArrow(run, T.StructType([T.StructField(LABEL, rows.schema[LABEL].dataType.elementType)]))


def _known_labels(cells: DataFrame, rows: DataFrame, hashes=None) -> tuple[list[str], list]:
    """The labels of ``rows`` in binary order, and how these stand in them: as hashes if ``cells`` have a book."""
    found = _labels_in(rows, hashes)
    if BOOK not in cells.columns:
        known = sorted_labels(found, LABEL)
        return known, known
    ids = [int(h) for h in sorted_labels(found.select(F.col(LABEL).cast("string").alias(LABEL)), LABEL)]
    if not ids:
        return [], []
    own = F.broadcast(cells.sparkSession.createDataFrame([(h,) for h in ids], "hash long"))
    book = cells.select(F.explode(BOOK).alias("entry")).select("entry.*").distinct().join(own, "hash", "left_semi").collect()
    if len(book) != len(ids):
        raise ValueError("two labels have one hash")
    book = sorted(book, key=lambda e: e["label"].encode("utf-8"))
    return [e["label"] for e in book], [e["hash"] for e in book]


def _laid_out(rows: DataFrame, names: Sequence[str], wanted: Sequence, hashes=None) -> DataFrame:
    """Rows of ``names`` and the arrays ``LABEL`` and ``VALUE`` as a column per entry of ``wanted``, in Arrow."""
    only, n = _only(hashes), len(wanted)

    def wide(batch):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        labels, values = batch.column(LABEL), batch.column(VALUE).flatten()
        flat = labels.flatten()
        code = pc.index_in(flat, value_set=pa.array(wanted, flat.type)).fill_null(-1).to_numpy()
        row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(labels).to_numpy())
        there = np.flatnonzero(code >= 0)
        at = np.full((n, batch.num_rows), -1, np.int32)
        at[code[there], row[there]] = there
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(values.take(pa.array(a, mask=a < 0)) for a in at)],
                                          schema.names)

    def run(batches):
        step = max(1, SPREAD_CELLS // n)
        for batch in batches:
            batch = only(batch)
            for start in range(0, batch.num_rows, step):
                yield wide(batch.slice(start, step))

    kind = rows.schema[VALUE].dataType.elementType
    schema = T.StructType([*(rows.schema[c] for c in names), *(T.StructField(f"__v{i}", kind) for i in range(n))])
    own = [F.xxhash64(rows["__who"]).alias("__who")] if hashes is not None else []
    return rows.select(*names, LABEL, VALUE, *own).mapInArrow(run, schema)


def pivot_kept(df: DataFrame, keys: Sequence[str], pivot_col: str, value_col: str, order: Sequence[str],
               participant: str, assessment: str, min_exclusive: int = 25, labels_of_kept: bool = True,
               broadcast_rows: int | None = 1_000_000, clean: bool = False) -> DataFrame:
    """Qualify and pivot in one read of the raw answers.

    The answers are gathered where they lie (:func:`gathered`), reduced to the earliest value of
    each label, and stored, one row per assessment and stretch of answers; everything else reads
    those rows: the distinct assessments per participant (two-level, so a participant with a third
    of all rows is spread over its assessments), the participants with more than ``min_exclusive``,
    the labels that those answered (or, without ``labels_of_kept``, that anyone answered), and the
    wide table.  So no single answer is shuffled or sorted: an assessment's answers move as one
    row, and once, on all ``keys``, where stretches of the same
    assessment are merged, in as many tasks as the number of answers asks for (a number from the
    shuffle's compressed size lets tasks sort and spill many times that).  A stretch holds a label once, so an assessment with very many raw
    answers is small by then.  Of more than ``MOVED_ANSWERS`` answers only the assessments in several
    stretches are moved, if they are few enough to be told by a broadcast of their keys' hashes: moving
    the others merges nothing, and a task that moves many holds all it read, and spills.  Reduced rows
    are laid out as columns in Arrow (:func:`_laid_out`).
    The kept ids are broadcast if a count shows at most ``broadcast_rows``; up to ``HASHED_IDS`` are told
    by their hashes, which every task gets as one array, if none is shared with a participant that is not
    kept; more are joined by shuffle, where AQE splits a participant with many rows, with positions for
    labels, and the rows found are stored.
    With ``clean`` the labels are cleaned (:func:`clean_label`), before answers count as of one label.
    ``participant`` and ``assessment`` are among ``keys``.
    """
    names = [f"__key{i}" for i in range(len(keys))]
    by = [f"__by{i}" for i, _ in enumerate(order)]
    own = list(dict.fromkeys(VALUE if o == value_col else b for o, b in zip(order, by)))  # a value that is ordered by is moved once
    parts = [LABEL, *own, *[VALUE] * (VALUE not in own)]
    plain = [LABEL, *[o for o in own if o != VALUE], VALUE]  # as _earliest leaves them
    # a time only orders, and is stored in half the time as a number
    ordered = lambda o: F.unix_micros(_c(o)) if isinstance(df.schema[o].dataType, T.TimestampType) else _c(o)
    sources = {VALUE: _c(value_col)} | {b: ordered(o) for o, b in zip(order, by) if o != value_col}
    # where answers are gathered in Arrow, a label is cleaned once for all its rows there
    in_arrow = clean and reduces(df.select(_c(pivot_col).alias(LABEL), *sources.values()).schema)
    label = clean_label(pivot_col) if clean and not in_arrow else _c(pivot_col)
    flat = df.select(*[_c(k).alias(n) for k, n in zip(keys, names)], label.alias(LABEL, metadata={"unclean": True} if in_arrow else {}),
                     *[sources[p].alias(p, metadata={"tie": True} if p == VALUE and VALUE not in own else {}) for p in parts[1:]])
    kind, value_kind = flat.schema[LABEL].dataType, flat.schema[VALUE].dataType

    def placed(labels: Sequence[str]) -> Column:
        return F.transform(LABEL, lambda v: _position(v, labels, kind))

    cells = gathered(flat, len(names))
    if not reduces(flat.schema):
        cells = _earliest(cells.select(*names, F.arrays_zip(*plain).alias("__cells")), names, own)
        cells = cells.select(*names, *[F.col("__cells").getField(p).alias(p) for p in parts])
    cells = handover(cells.withColumn("__answers", F.size(LABEL)), "answer_cells")
    who, what = (names[list(keys).index(k)] for k in (participant, assessment))
    per = assessments_per_participant(cells, who, what)
    counts = handover(per.select(who, (F.col("totalAssessments") > min_exclusive).alias("kept")), "small_side")
    ids = counts.where("kept").select(who)
    few, hashes, kept = fits_broadcast(ids, broadcast_rows), None, cells
    if few:
        kept = cells.join(F.broadcast(ids), who, "left_semi")
    else:
        hashes = _hashes_of_kept(counts, who, HASHED_IDS)
    marked = lambda rows: rows.withColumn("__who", F.col(who))
    if few or hashes is not None:  # labels of others than the kept cannot occur
        labels, wanted = _known_labels(cells, marked(kept if labels_of_kept else cells), hashes if labels_of_kept else None)
    elif BOOK in cells.columns:
        kept = handover(cells.join(ids, who, "left_semi"), "kept_cells")
        labels, wanted = _known_labels(cells, kept if labels_of_kept else cells)
    else:
        known = sorted_labels(_labels_in(cells), LABEL)
        kept = handover(cells.withColumn(LABEL, placed(known)).join(ids, who, "left_semi"), "kept_cells")
        wanted = sorted(r[0] for r in _labels_in(kept).dropna().distinct().collect()) if labels_of_kept else list(range(len(known)))
        labels = [known[i] for i in wanted]
    if not wanted:
        return kept.join(ids, who, "left_semi").select(*[_c(n).alias(k) for n, k in zip(names, keys)]).distinct()
    size = lambda rows: rows.agg(F.sum("__answers").alias("n")).first()["n"] or 0
    cells_of = lambda s: F.arrays_zip(*[s.getField(p).alias(p) for p in plain])
    unzipped = lambda rows: rows.select(*names, *[F.col("__cells").getField(p).alias(p) for p in (LABEL, VALUE)])
    answers, alone = size(cells), None
    if answers > MOVED_ANSWERS and "collate" not in cells.schema.simpleString():  # such keys may be equal and hash apart
        # equal hashes of different keys only move more than has to
        hashed = kept.withColumn("__hash", F.xxhash64(*names))
        several = handover(hashed.groupBy("__hash").agg(F.count("*").alias("n")).where("n > 1").select("__hash"), "several_stretches")
        if fits_broadcast(several, broadcast_rows):
            alone = hashed.join(F.broadcast(several), "__hash", "left_anti").select(*names, LABEL, VALUE)
            kept = hashed.join(F.broadcast(several), "__hash", "left_semi").drop("__hash")
            answers = size(kept)
    stretches = kept.repartition(max(2, -(-answers // MERGE_ANSWERS)), *names).groupBy(*names).agg(F.collect_list(F.struct(*plain)).alias("__stretches"))
    rows = stretches.select(*names, F.flatten(F.transform("__stretches", cells_of)).alias("__cells"), (F.size("__stretches") > 1).alias("__several"))
    rows = unzipped(_earliest(rows, names, own, F.col("__several")))
    if alone is not None:
        rows = alone.unionByName(rows)
    return _laid_out(marked(rows), names, wanted, hashes).toDF(*keys, *labels)


def pivot_agg(df: DataFrame, keys: Sequence[str], pivot_col: str, values: Sequence[str],
              agg) -> DataFrame:
    """Pivot with any aggregate, e.g. ``F.max`` (A4); ``agg`` maps a column to an aggregate."""
    return df.groupBy(*[_c(k) for k in keys]).pivot(pivot_col, list(values)).agg(agg)


def distinct_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of distinct key groups, one row (A14): equals the pivot's row count."""
    return df.select(*[_c(k) for k in keys]).distinct().agg(F.count(F.lit(1)).alias("n_groups"))


# -- baseline spread ---------------------------------------------------------

def spread_baseline(moment: DataFrame, base: DataFrame, moment_key: str, base_key: str,
                    broadcast_rows: int | None = None, salt_buckets: int = 0,
                    salt_by: Sequence[str] | None = None) -> DataFrame:
    """Every momentary row with its participant's baseline columns.

    Inner equi-join: participants lacking either side vanish.  Three plans:

    * ``broadcast_rows``: the baseline (one row per participant) is counted
      first and broadcast when it has at most that many rows; the momentary
      side is then not shuffled at all, so no participant can be hot.
    * ``salt_buckets``: otherwise (or without a count), a salted sort-merge
      join (:func:`salted_join`, salt from ``salt_by``, default all momentary
      columns) spreads each participant with a large share of the rows over
      that many tasks; all others are joined without salt.  AQE cannot split
      such a participant itself when an aggregate by participant follows,
      since the split would need another shuffle.
    * neither: the planner chooses (AQE broadcast or skew-split join).
    """
    cond = moment[moment_key] == base[base_key]
    if fits_broadcast(base, broadcast_rows):
        return moment.join(F.broadcast(base), cond, "inner")
    if salt_buckets > 1:
        return salted_join(moment, base, [(moment_key, base_key)], "inner", salt_buckets,
                           salt_by or moment.columns)
    return moment.join(base, cond, "inner")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys with more than one row; empty when ``df`` is one row per participant.

    A baseline with two rows for a participant would duplicate that participant's
    momentary rows in :func:`spread_baseline`.
    """
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)
