"""One pass over rows that stand in the order of a window: vectorised work on many small keys at a time.

Rules that look at a whole printed line, such as splitting its gaps in two or walking over its blanks, need several windows
and folds when they are put in columns. Here the window only brings a key's rows together and in order; its rows then go
through one Arrow pass, many keys in a batch, worked on as arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FIRST = "_first"


class Rows:
    """Rows of one batch whose columns are made when they are asked for: numpy arrays without nulls, Arrow arrays, or calls
    that give one of these. Steps of a pass hand them on, so a column that no later step reads is never made."""

    def __init__(self, num_rows: int, columns: dict):
        self.num_rows, self._columns = num_rows, columns

    @classmethod
    def of(cls, batch) -> Rows:
        return batch if isinstance(batch, cls) else cls(batch.num_rows, dict(zip(batch.schema.names, batch.columns)))

    def raw(self, name: str):
        made = self._columns[name]
        if callable(made):
            made = self._columns[name] = made()
        return made

    def arrow(self, name: str):
        import numpy as np
        import pyarrow as pa

        made = self.raw(name)
        if isinstance(made, np.ndarray):
            made = letters(made.view(np.uint32)) if made.dtype == "<U1" else pa.array(made)
        return made

    def null(self, name: str):
        """Where the column is null, None if nowhere."""
        import numpy as np

        made = self.raw(name)
        return None if isinstance(made, np.ndarray) or not made.null_count else made.is_null().to_numpy(zero_copy_only=False)

    def filled(self, name: str, value=0):
        """The column as a numpy array with `value` for null."""
        import numpy as np

        made = self.raw(name)
        if isinstance(made, np.ndarray):
            return made
        return (made.fill_null(value) if made.null_count else made).to_numpy(zero_copy_only=False)

    def text(self, name: str) -> bool:
        import numpy as np
        import pyarrow as pa

        made = self.raw(name)
        return made.dtype == "<U1" if isinstance(made, np.ndarray) else pa.types.is_string(made.type) or pa.types.is_large_string(made.type)

    def codes(self, name: str):
        """Code points of a column of single characters (of others the first), nothing for null."""
        import numpy as np

        made = self.raw(name)
        return made.view(np.uint32) if isinstance(made, np.ndarray) else first_codes(made)

    def take(self, rows) -> Rows:
        return Rows(len(rows), {name: partial(self._taken, name, rows) for name in self._columns})

    def _taken(self, name: str, rows):
        import numpy as np
        import pyarrow as pa

        made = self.raw(name)
        return made[rows] if isinstance(made, np.ndarray) else made.take(pa.array(rows))

    def plus(self, **columns) -> Rows:
        return Rows(self.num_rows, {name: partial(self.raw, name) for name in self._columns} | columns)

    def batch(self, schema):
        import pyarrow as pa

        made = [self.arrow(f.name) for f in schema]
        return pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(made, schema)], schema=schema)


def letters(codes):
    """An Arrow array of the characters with these code points."""
    import numpy as np
    import pyarrow as pa

    ends = np.zeros(len(codes) + 1, np.int32)
    np.cumsum(1 + (codes >= 0x80).astype(np.int8) + (codes >= 0x800) + (codes >= 0x10000), out=ends[1:])
    data = np.ascontiguousarray(codes).tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    return pa.StringArray.from_buffers(len(codes), pa.py_buffer(ends), pa.py_buffer(data))


def text_codes(texts):
    """(code points of all texts one behind the other, number of them in each text). Null texts have none."""
    import numpy as np
    import pyarrow as pa

    texts = (texts.fill_null("") if texts.null_count else texts).cast(pa.string())
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int32)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    data = np.frombuffer(data or b"", np.uint8)[ends[0]:ends[-1]]
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    codes = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.diff(before[ends - ends[0]])


def first_codes(texts):
    """The first code point of every text, zero where it has none."""
    import numpy as np

    codes, n = text_codes(texts)
    if (n == 1).all():
        return codes
    begin = np.cumsum(n) - n
    return np.where(n > 0, np.append(codes, 0)[np.minimum(begin, len(codes))], 0).astype(np.uint32)


class Matching:
    """The characters that a pattern of Spark's `rlike` finds, by code point."""

    def __init__(self, bits: bytes):
        self.bits, self._table = bits, None

    def __reduce__(self):
        return Matching, (self.bits,)

    def __getitem__(self, codes):
        import numpy as np

        if self._table is None:
            self._table = np.unpackbits(np.frombuffer(self.bits, np.uint8)).astype(bool)
        return self._table[codes]


_MATCHING: dict[str, Matching] = {}


def matching(spark, pattern: str) -> Matching:
    """Every character is tried once by Spark itself, so that passes and columns agree. Unicode bounds what is gathered."""
    import numpy as np

    if pattern not in _MATCHING:
        n = spark.range(0, 0x110000, 1, 4).filter("id not between 55296 and 57343")
        c = F.expr("substring(decode(concat(unhex('00000041'), unhex(lpad(hex(id), 8, '0'))), 'UTF-32'), 2)")
        found = n.filter(c.rlike(pattern)).toArrow().column("id").to_numpy()
        hit = np.zeros(0x110000, bool)
        hit[found] = True
        _MATCHING[pattern] = Matching(np.packbits(hit).tobytes())
    return _MATCHING[pattern]


def per_key(df: DataFrame, keys: list[str], order: list[str | Column], work: Callable, schema: StructType, stands: list[str] | None = None) -> DataFrame:
    """`work(batch)` turns an Arrow batch that holds whole keys, each in `order`, into columns of `schema`; the column FIRST
    marks the first row of every key. A batch holds as many keys as fit Spark's batch size, one long key at least.

    `stands` names columns of the result whose equal rows come one behind the other, in order; `behind` then adds work on them,
    or on parts of them, to the same pass.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return _passed(df.select("*", (F.row_number().over(w) == 1).alias(FIRST)), None, [(work, schema)], stands)


def made_by(df: DataFrame, source: DataFrame, keys: list[str], order: list[str], parts: Callable) -> DataFrame:
    """`df`, with a shorter way to its rows for passes: `parts(batch)` gives them as `Rows`, whole `keys` at a time, from a batch
    of the few rows of `source`, which holds whole keys in `order`, FIRST marking where one begins."""
    w = Window.partitionBy(*keys).orderBy(*order)
    made = partial(parts)
    made.order = order
    object.__setattr__(df, "_pass", (source.select("*", (F.row_number().over(w) == 1).alias(FIRST)), made, [], keys))
    return df


#: Bytes of the source's texts that a meeting takes at a time: more where a key has more.
MEETING_BYTES = 1 << 18


def meeting(df: DataFrame, others: DataFrame, work: Callable, schema: StructType) -> DataFrame | None:
    """`work(rows, others)` on whole keys of `df`, whose view `made_by` gave, and the rows of `others` of these keys, in one pass. Rows
    of keys that `df` does not have are left out. Besides the keys, `others` shares no column with the view's source. None if `df`
    is something else."""
    from pyspark.sql.pandas.types import to_arrow_schema

    source, parts, steps, keys = getattr(df, "_pass", (None,) * 4)
    if not hasattr(parts, "order"):
        return None
    both = source.drop(FIRST).withColumn("_mine", F.lit(True)).unionByName(others, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.col("_mine").desc_nulls_last(), *parts.order)
    targets = [(step, to_arrow_schema(made)) for step, made in steps]
    met = partial(_met, parts=partial(parts), targets=targets, names=others.columns, work=work)
    return _passed(both.select("*", (F.row_number().over(w) == 1).alias(FIRST)), met, [(Rows.of, schema)], keys)


def _met(batch, parts: Callable, targets: list, names: list[str], work: Callable):
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    mine = batch.column(batch.schema.get_field_index("_mine")).is_valid()
    key, is_mine = np.cumsum(column(batch, FIRST)), mine.to_numpy(zero_copy_only=False)
    own, rest, key, other = batch.filter(mine), batch.filter(pc.invert(mine)).select(names), key[is_mine], key[~is_mine]
    size = np.ones(own.num_rows, np.int64)
    for c in own.columns:
        if pa.types.is_string(c.type):
            size += pc.binary_length(c).fill_null(0).to_numpy(zero_copy_only=False)
    cut, before = [0], np.cumsum(size) - size
    for i in (np.flatnonzero(key[1:] != key[:-1]) + 1).tolist():
        if before[i] - before[cut[-1]] >= MEETING_BYTES:
            cut.append(i)
    for begin, end in zip(cut, [*cut[1:], own.num_rows]):
        met = []
        for rows in parts(own.slice(begin, end - begin)) if end else []:
            for step, target in targets:
                if rows.num_rows:
                    rows = _typed(step(rows), target)
            if rows.num_rows:
                met.append(rows)
        if len(met) > 1:
            table = pa.Table.from_batches([rows.batch(targets[-1][1]) for rows in met])
            met = [Rows.of(table.combine_chunks().to_batches()[0])]
        if met:
            low, high = np.searchsorted(other, key[begin]), np.searchsorted(other, key[end - 1], "right")
            yield work(met[0], Rows.of(rest.slice(low, high - low)))


def in_hand(df: DataFrame, keys: list[str]) -> bool:
    """Whether a pass has whole `keys` of `df` in hand, so that `behind` can go on with them."""
    stands = getattr(df, "_pass", (None,))[-1]
    return stands is not None and set(stands) <= set(keys)


def behind(done: DataFrame, keys: list[str], work: Callable, schema: StructType, order: list[str] | None = None, stands: list[str] | None = None) -> DataFrame | None:
    """`work` on the rows of `done` if a pass has just left them in order by `keys`, as a further step of that pass: rows that
    Python has in hand are neither exchanged nor sorted again. Where the pass left whole groups by some of the `keys` only, the
    rows of a batch are brought together by all of them first. Within a key they come in `order` (numbers; null first), else as
    they stand. None if `done` is something else."""
    if not in_hand(done, keys):
        return None
    source, parts, steps, standing = done._pass
    step = partial(_together, work, standing, [k for k in keys if k not in standing], order or [])
    return _passed(source, parts, [*steps, (step, schema)], stands)


def also(df: DataFrame, without: tuple = (), **columns) -> DataFrame:
    """`df` with more columns, or others under their names, each given by one function for columns and for arrays: it is called with a
    function that gives a column by its name and, if wanted, a value in place of null. Null in what it reads makes null."""
    out = df.withColumns({name: _column(make(_of_columns)) for name, make in columns.items()}).drop(*without)
    return _with_step(df, out, partial(_also, makes=columns))


def only(df: DataFrame, where: Callable) -> DataFrame:
    """The rows of `df` for which the function, as in `also`, is true."""
    return _with_step(df, df.filter(where(_of_columns)), partial(_only, where=where))


def several(df: DataFrame, name: str, cases: list[tuple[Callable, list[int]]], otherwise: list[int]) -> DataFrame:
    """A row of `df` for each number, as column `name`, that the first true case has, the cases' functions being as in `also`."""
    numbers = F.array(*map(F.lit, otherwise))
    for where, some in reversed(cases):
        numbers = F.when(where(_of_columns), F.array(*map(F.lit, some))).otherwise(numbers)
    return _with_step(df, df.select("*", F.explode(numbers).alias(name)), partial(_several, name=name, cases=cases, otherwise=otherwise))


def choose(condition, a, b):
    """`a` where the column or array `condition` is true, else `b`."""
    import numpy as np

    return F.when(condition, a).otherwise(b) if isinstance(condition, Column) else np.where(condition, a, b)


def _of_columns(name: str, null=None) -> Column:
    return F.col(name) if null is None else F.coalesce(F.col(name), F.lit(null))


def _column(made) -> Column:
    return made if isinstance(made, Column) else F.lit(made)


def _with_step(df: DataFrame, out: DataFrame, step: Callable) -> DataFrame:
    if getattr(df, "_pass", (None,))[-1] is not None:
        source, parts, steps, stands = df._pass
        object.__setattr__(out, "_pass", (source, parts, [*steps, (step, out.schema)], stands))
    return out


def _read(rows: Rows, make: Callable):
    """What `make` gives for the rows, and where a column that it read was null."""
    import numpy as np

    gaps = []

    def of(name, null=None):
        if null is None and (gap := rows.null(name)) is not None:
            gaps.append(gap)
        values = rows.codes(name).view("<U1") if rows.text(name) else rows.filled(name, 0 if null is None else null)
        return values.astype(np.int64) if values.dtype.kind == "i" else values
    made = make(of)
    return made, np.logical_or.reduce(gaps) if gaps else None


def _also(rows: Rows, makes: dict) -> Rows:
    def made(make):
        import numpy as np
        import pyarrow as pa

        values, gap = _read(rows, make)
        values = values if isinstance(values, np.ndarray) else np.full(rows.num_rows, values)
        return values if gap is None else pa.array(values, mask=gap)
    return rows.plus(**{name: partial(made, make) for name, make in makes.items()})


def _only(rows: Rows, where: Callable) -> Rows:
    import numpy as np

    keep, gap = _read(rows, where)
    return rows.take(np.flatnonzero(keep if gap is None else keep & ~gap))


def _several(rows: Rows, name: str, cases: list, otherwise: list[int]) -> Rows:
    import numpy as np

    case = np.full(rows.num_rows, len(cases))
    for i, (where, _) in reversed(list(enumerate(cases))):
        hit, gap = _read(rows, where)
        case[hit if gap is None else hit & ~gap] = i
    numbers = [*(some for _, some in cases), otherwise]
    n = np.array([len(x) for x in numbers])
    begin, count = np.cumsum(n) - n, n[case]
    at = np.repeat(np.arange(rows.num_rows), count)
    place = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
    return rows.take(at).plus(**{name: np.concatenate([np.array(x, np.int64) for x in numbers])[begin[case][at] + place]})


def _passed(source: DataFrame, parts: Callable | None, steps: list, stands: list[str] | None) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    targets = [(work, to_arrow_schema(schema)) for work, schema in steps]

    def run(batches: Iterator):
        for batch in whole_keys(batches):
            for rows in parts(batch) if parts else [batch]:
                for work, target in targets:
                    if rows.num_rows:
                        rows = _typed(work(rows), target)
                if rows.num_rows:
                    yield rows.batch(targets[-1][1])

    out = source.mapInArrow(run, steps[-1][1])
    if stands is not None:
        object.__setattr__(out, "_pass", (source, parts, steps, stands))
    return out


def _typed(made, target) -> Rows:
    """What a step made, a list of columns or Rows that have them, with the types of its schema."""
    if not isinstance(made, Rows):
        made = Rows(len(made[0]), dict(zip(target.names, made)))
    return Rows(made.num_rows, {f.name: partial(_cast, made, f) for f in target})


def _cast(rows: Rows, field):
    import numpy as np

    made, kind = rows.raw(field.name), field.type
    if isinstance(made, np.ndarray):
        if made.dtype == "<U1" or made.dtype == kind.to_pandas_dtype():
            return made
        made = rows.arrow(field.name)
    return made if made.type == kind else made.cast(kind)


def ranked(rows: Rows, name: str):
    """The column as numbers that are ordered and equal as its values are, null before all others."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    made = rows.raw(name)
    if isinstance(made, np.ndarray):
        return made.view(np.uint32) if made.dtype == "<U1" else made
    if pa.types.is_integer(made.type) or pa.types.is_boolean(made.type) or pa.types.is_floating(made.type):
        if not made.null_count:
            return made.to_numpy(zero_copy_only=False)
        if pa.types.is_floating(made.type):
            return pc.fill_null(made, float("-inf")).to_numpy(zero_copy_only=False)
        return pc.fill_null(made.cast(pa.int64()), -1 << 63).to_numpy(zero_copy_only=False)
    return pc.subtract(pc.rank(made, sort_keys="ascending", null_placement="at_start", tiebreaker="min"), 1).to_numpy(zero_copy_only=False)


def _together(work: Callable, standing: list[str], further: list[str], order: list[str], batch):
    """`work` on rows put together by the `further` keys within equal `standing` ones, and in `order`, with FIRST where a key changes
    (null is a value). Rows that already stand so are left alone."""
    import numpy as np

    rows = Rows.of(batch)
    n = rows.num_rows
    group = np.zeros(n, bool)
    group[:1] = True
    for k in standing:
        v = ranked(rows, k)
        gap = rows.null(k)
        group[1:] |= v[1:] != v[:-1]
        if gap is not None:
            group[1:] |= gap[1:] != gap[:-1]
    by = [ranked(rows, k) for k in [*further, *order]]
    tie, sorted_ = ~group[1:], True
    for v in by:
        if (tie & (v[1:] < v[:-1])).any():
            sorted_ = False
            break
        tie = tie & (v[1:] == v[:-1])
    if not sorted_:
        at = np.lexsort([*reversed(by), np.cumsum(group)])
        rows, by = rows.take(at), [v[at] for v in by[:len(further)]]
    first = group.copy()
    for v in by[:len(further)]:
        first[1:] |= v[1:] != v[:-1]
    return work(rows.plus(**{FIRST: first}))


def whole_keys(batches: Iterator) -> Iterator:
    """The rows of `batches` cut before first rows of keys only."""
    import numpy as np
    import pyarrow as pa

    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        first = np.flatnonzero(batch.column(batch.schema.get_field_index(FIRST)).to_numpy(zero_copy_only=False))
        if not len(first):
            held.append(batch)
            continue
        if first[-1] or held:
            done = [*held, batch.slice(0, first[-1])]
            whole = pa.Table.from_batches([b for b in done if b.num_rows], batch.schema).combine_chunks()
            if whole.num_rows:
                yield whole.to_batches()[0]
        held = [batch.slice(first[-1])]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def column(batch, name: str):
    """A column as a numpy array; nulls of numbers are NaN."""
    return Rows.of(batch).filled(name) if _plain(batch, name) else Rows.of(batch).arrow(name).to_numpy(zero_copy_only=False)


def _plain(batch, name: str) -> bool:
    import numpy as np

    return isinstance(Rows.of(batch).raw(name), np.ndarray)


def two_means(values, begin, rounds: int = 20):
    """(c1, c2) of the 2-means of each stretch of sorted `values` that starts at `begin`, from its least and largest value.
    Only the two sums of a stretch change between rounds."""
    import numpy as np

    if not len(begin):
        return np.zeros(0), np.zeros(0)
    end = np.append(begin[1:], len(values))
    c1, c2 = values[begin].copy(), values[end - 1].copy()
    stretch = np.repeat(np.arange(len(begin)), end - begin)
    done = np.zeros(len(begin), bool)
    for _ in range(rounds):
        low = values <= ((c1 + c2) / 2)[stretch]
        n_low = np.add.reduceat(low, begin, dtype=np.int64)
        n_high = end - begin - n_low
        done |= (n_low == 0) | (n_high == 0)
        a = np.add.reduceat(np.where(low, values, 0.0), begin) / np.maximum(n_low, 1)
        b = np.add.reduceat(np.where(low, 0.0, values), begin) / np.maximum(n_high, 1)
        still = done | ((a == c1) & (b == c2))
        c1, c2 = np.where(done, c1, a), np.where(done, c2, b)
        done = still
        if done.all():
            break
    return c1, c2
