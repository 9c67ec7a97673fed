"""Ordered computations per key that never put a whole key into one task.

A plain ``Window.partitionBy(symbol)`` sorts every row of a symbol in a single task, which does
not hold when one symbol owns a large share of the table. A :class:`Timeline` splits each key
along its own order instead:

1. rows are counted per ``(key, slice)``, where the slice is a coarse deterministic bucket of the
   order column, and the counts are prefix-summed: every row gets its exact position in the key;
2. positions are cut into equal chunks. A chunk also receives copies of the ``back`` rows before
   and ``ahead`` rows after it, so any bounded frame is complete inside the chunk;
3. unbounded prefixes (running sums, maxima, last known value) are a local scan per chunk plus
   the folded totals of the earlier chunks.

All windows of one timeline share partitioning and order, so they cost one exchange together.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

CHUNK_ROWS = 16_384
CHUNK_SETTING = "tidewater.chunk.rows"

_SLICE, _CHUNK, _POS, _TOTAL, _OWN, _BLOCK = "__tl_slice", "__tl_chunk", "__tl_pos", "__tl_total", "__tl_own", "__tl_block"


def time_slice(ts: str | Column, seconds: int) -> Column:
    """Coarse time bucket used to spread one key over many tasks."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_seconds(ts) / F.lit(seconds))


@dataclass(frozen=True)
class Timeline:
    df: DataFrame
    keys: tuple[str, ...]
    part: tuple[str, ...]
    order: tuple = field(default=())
    halo: bool = False
    block: int = 0
    gaps: bool = True

    # -- frames ---------------------------------------------------------------------------
    def window(self, lo: int | None = None, hi: int | None = 0) -> WindowSpec:
        """Row frame ``lo..hi`` around the current row; ``None`` is unbounded within the chunk."""
        w = Window.partitionBy(*self.part).orderBy(*self.order)
        return w.rowsBetween(
            Window.unboundedPreceding if lo is None else lo,
            Window.unboundedFollowing if hi is None else hi,
        )

    def ordered(self) -> WindowSpec:
        return Window.partitionBy(*self.part).orderBy(*self.order)

    def last(self, n: int) -> WindowSpec:
        """The current row and the ``n - 1`` before it."""
        return self.window(-(n - 1), 0)

    def lag(self, col: str | Column, n: int = 1) -> Column:
        return F.lag(col, n).over(self.ordered())

    def lead(self, col: str | Column, n: int = 1) -> Column:
        return F.lead(col, n).over(self.ordered())

    def full(self, fn, col: str | Column, n: int) -> Column:
        """Rolling ``fn`` that stays NULL until ``n`` non-NULL values are in the frame."""
        col = F.col(col) if isinstance(col, str) else col
        w = self.last(n)
        return F.when(F.count(col).over(w) == n, fn(col).over(w))

    def centred(self, fn, col: str | Column, lo: int, hi: int) -> Column:
        col = F.col(col) if isinstance(col, str) else col
        w = self.window(lo, hi)
        return F.when(F.count(col).over(w) == hi - lo + 1, fn(col).over(w))

    @property
    def pos(self) -> Column:
        """0-based position of the row inside its key."""
        return F.col(_POS)

    @property
    def total(self) -> Column:
        """Number of rows of the key."""
        return F.col(_TOTAL)

    def _rank(self) -> Column:
        """Ascending order value of a row inside its chunk."""
        if _POS in self.df.columns:
            return self.pos
        if not all(isinstance(o, str) for o in self.order):
            raise ValueError("this scan needs positions: lay out with positions=True")
        return F.struct(*self.order)

    @property
    def own(self) -> Column:
        return F.col(_OWN) if self.halo else F.lit(True)

    # -- steps ----------------------------------------------------------------------------
    def add(self, **cols: Column) -> "Timeline":
        return replace(self, df=self.df.withColumns(cols))

    def drop(self, *cols: str) -> "Timeline":
        return replace(self, df=self.df.drop(*cols))

    def running(self, **specs) -> "Timeline":
        """Exact unbounded-prefix scans.

        Each spec is ``(op, column)`` with op one of ``sum count product max min last next``; ``last`` is
        the latest non-NULL value up to the row, ``next`` the first non-NULL value from the row
        on. Append ``"<"`` to the op to leave the current row out.
        """
        folds, carries, exprs = [], [], {}
        by_chunk = Window.partitionBy(*self.keys).orderBy(self.part[-1])
        before = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
        after = by_chunk.rowsBetween(1, Window.unboundedFollowing)
        for name, (op, col) in specs.items():
            col = F.col(col) if isinstance(col, str) else col
            strict, op = op.endswith("<"), op.rstrip("<")
            val = F.when(self.own, col) if self.halo else col
            t, c = f"__t_{name}", f"__c_{name}"
            frame = self.window(1 if strict else 0, None) if op == "next" else self.window(None, -1 if strict else 0)
            if op in ("sum", "count"):
                fn = F.sum if op == "sum" else F.count
                folds.append(fn(val).alias(t))
                carries.append(F.sum(t).over(before).alias(c))
                local = fn(val).over(frame)
                exprs[name] = F.coalesce(F.col(c) + local, F.col(c), local)
            elif op == "product":
                folds.append(F.product(val).alias(t))
                carries.append(F.product(t).over(before).alias(c))
                local = F.product(val).over(frame)
                exprs[name] = F.coalesce(F.col(c) * local, F.col(c), local)
            elif op in ("max", "min"):
                fn, pick = (F.max, F.greatest) if op == "max" else (F.min, F.least)
                folds.append(fn(val).alias(t))
                carries.append(fn(t).over(before).alias(c))
                exprs[name] = pick(F.col(c), fn(val).over(frame))
            elif op == "last":
                folds.append(F.max_by(val, F.when(val.isNotNull(), self._rank())).alias(t))
                carries.append(F.last(t, ignorenulls=True).over(before).alias(c))
                exprs[name] = F.coalesce(F.last(val, ignorenulls=True).over(frame), F.col(c))
            elif op == "next":
                folds.append(F.min_by(val, F.when(val.isNotNull(), self._rank())).alias(t))
                carries.append(F.first(t, ignorenulls=True).over(after).alias(c))
                exprs[name] = F.coalesce(F.first(val, ignorenulls=True).over(frame), F.col(c))
            else:
                raise ValueError(f"unknown scan {op!r}")
        totals = self.df.where(self.own).groupBy(*self.part).agg(*folds)
        carry = totals.select(*self.part, *carries)
        df = join_keys(self.df, carry, list(self.part), "left").withColumns(exprs)
        return replace(self, df=df.drop(*[f"__c_{n}" for n in specs]))

    def smooth(self, whole: bool = False, **specs) -> "Timeline":
        """Linear recurrences ``y[t] = a*x[t] + (1-a)*y[t-1]``.

        Each spec is ``(x, a)`` or ``(x, a, start, n)``: y is NULL before position ``start``, equals
        the mean of the last ``n`` values there, and follows the recurrence after. Weights fade by ``1 - a`` per row,
        so two blocks of ``block_rows(a)`` rows determine y to double precision and a bounded halo
        is enough: inside a block y is a weighted running sum, and the only carry is the end of
        the block before. Rows with a NULL x keep the y before them; the next known row weighs the
        old y by the length of the gap, as an exponential mean over missing values does.

        ``whole``: x is NULL only where the input of the timeline is. Where the input is known to have no NULL (``gaps`` is
        False) the gap logic, four window passes of six, is then left out; the values are the same.
        """
        parsed = {}
        for name, spec in specs.items():
            x, a = spec[0], float(spec[1])
            x = F.col(x) if isinstance(x, str) else x
            start, n = (spec[2], spec[3]) if len(spec) > 2 else (0, 1)
            parsed[name] = (x, a, start, n)
        sizes: dict[int, list[str]] = {}
        for name, (_, a, _, _) in parsed.items():
            fits = block_rows(a) <= self.block and exact_in(a, self.block)
            sizes.setdefault(self.block if fits else block_rows(a), []).append(name)
        tl = self
        for size, names in sizes.items():
            form = tl._smooth_whole if whole and not self.gaps else tl._smooth_blocks
            tl = form(size, {n: parsed[n] for n in names})
        return tl

    def _smooth_whole(self, size: int, specs: dict) -> "Timeline":
        """The recurrences of series without NULL: a weighted running sum per block, and the end of the block before."""
        shared = size == self.block
        blk = _BLOCK if shared else "__blk"
        tl = self if shared else self.add(__blk=F.expr(f"{_POS} div {size}"))
        order = (_POS,) if shared else tl.order
        k = tl.pos % F.lit(size)
        inner = Window.partitionBy(*tl.part, blk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        decays = {a: f"__w_{i}" for i, a in enumerate(sorted({s[1] for s in specs.values()}))}
        tl = tl.add(**{w: F.exp(k * math.log(1.0 - a)) for a, w in decays.items()})
        local, value = {}, {}
        for n, (x, a, start, m) in specs.items():
            w = F.col(decays[a])
            seed = F.when(tl.pos > start - m, x / m * F.pow(F.lit(1.0 - a), tl.pos - start)).otherwise(F.lit(0.0)) if m > 1 else F.when(tl.pos == start, x).otherwise(F.lit(0.0))
            term = F.when(tl.pos > start, F.lit(a) * x).otherwise(seed)
            local[f"__l_{n}"] = F.sum(term / w).over(inner) * w
        tl = tl.add(**local)
        before = tl.window(None, -1)
        for n, (_, a, start, _) in specs.items():
            end = F.last(F.when(k == size - 1, F.col(f"__l_{n}")), ignorenulls=True).over(before)
            value[n] = F.when(tl.pos >= start, F.col(f"__l_{n}") + F.coalesce(end * F.col(decays[a]) * (1.0 - a), F.lit(0.0)))
        return tl.add(**value).drop(*local, *decays.values(), *([] if shared else ["__blk"]))

    def _smooth_blocks(self, size: int, specs: dict) -> "Timeline":
        shared = size == self.block
        blk = _BLOCK if shared else "__blk"
        tl = self if shared else self.add(__blk=F.expr(f"{_POS} div {size}"))
        order = (_POS,) if shared else tl.order
        k = tl.pos % F.lit(size)
        inner = Window.partitionBy(*tl.part, blk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        known, shrink, local, carry, value = {}, {}, {}, {}, {}
        for n, (x, a, start, m) in specs.items():
            x = F.col(x) if isinstance(x, str) else x
            known[f"__x_{n}"] = x
            counts = (tl.pos > start) & x.isNotNull() | (tl.pos == start) & (F.lit(m > 1) | x.isNotNull())
            known[f"__k_{n}"] = F.when(counts, tl.pos)
        tl = tl.add(**known)
        # a known row after a gap of g rows has y = (d**g * y_before + a * x) / (d**g + a); without gaps the divisor is 1
        for n, (_, a, start, m) in specs.items():
            gap = tl.pos - F.last(f"__k_{n}", ignorenulls=True).over(tl.window(None, -1))
            divisor = F.when(gap == 1, F.lit(1.0)).otherwise(F.pow(F.lit(1.0 - a), gap) + a)
            first = (tl.pos <= start) if m > 1 else gap.isNull()
            shrink[f"__g_{n}"] = F.when(F.col(f"__k_{n}").isNull() | first, F.lit(1.0)).otherwise(divisor)
            shrink[f"__f_{n}"] = first
        tl = tl.add(**shrink)
        tl = tl.add(**{f"__d_{n}": F.product(f"__g_{n}").over(inner) for n in specs})
        for n, (_, a, start, m) in specs.items():
            x, d = F.col(f"__x_{n}"), F.lit(1.0 - a)
            # The seed rows are weighted so that at ``start`` each of them counts 1 / m.
            seed = F.when(tl.pos > start - m, x / m * F.pow(d, tl.pos - start)) if m > 1 else x
            term = F.when(F.col(f"__f_{n}"), seed).otherwise(F.lit(a) * x)
            before = F.col(f"__d_{n}") / F.col(f"__g_{n}")
            local[f"__l_{n}"] = F.coalesce(F.sum(term * before * F.pow(d, -k)).over(inner), F.lit(0.0)) * F.pow(d, k)
        tl = tl.add(**local)
        for n in specs:
            end = F.last(F.when(F.col(f"__k_{n}").isNotNull(), F.struct(F.col(f"__k_{n}").alias("at"), (F.col(f"__l_{n}") / F.col(f"__d_{n}")).alias("y"))), ignorenulls=True)
            carry[f"__e_{n}"] = F.when(k == size - 1, end.over(inner))
        tl = tl.add(**carry)
        for n, (_, a, start, _) in specs.items():
            end = F.last(f"__e_{n}", ignorenulls=True).over(tl.window(None, -1))
            carried = F.coalesce(end["y"] * F.pow(F.lit(1.0 - a), tl.pos - end["at"]), F.lit(0.0))
            y = F.when(F.col(f"__k_{n}").isNotNull(), (F.col(f"__l_{n}") + carried) / F.col(f"__d_{n}"))
            value[n] = y
        tl = tl.add(**value)
        tl = tl.add(**{n: F.when(tl.pos >= start, F.last(n, ignorenulls=True).over(tl.window(None, 0))) for n, (_, _, start, _) in specs.items()})
        return tl.drop(*known, *shrink, *local, *carry, *[f"__d_{n}" for n in specs], *([] if shared else ["__blk"]))

    def rows(self) -> DataFrame:
        """The rows that belong to each chunk, without helper columns."""
        df = self.df.where(F.col(_OWN)) if self.halo else self.df
        return df.drop(_SLICE, _CHUNK, _POS, _TOTAL, _OWN, _BLOCK, "__tl_start")


def free_of_nulls(df: DataFrame, cols: list[str]) -> bool:
    """Whether a stored table has no NULL in ``cols``, from the statistics of its files; False for anything but a stored table."""
    node = df._jdf.queryExecution().optimizedPlan()
    while node.getClass().getSimpleName() == "Project":
        node = node.child()
    if node.getClass().getSimpleName() != "LogicalRelation":
        return False
    some = None
    for c in cols:
        some = F.col(c).isNull() if some is None else some | F.col(c).isNull()
    return df.where(some).isEmpty()


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which NULL meets NULL; the key columns of ``left`` are kept."""
    named = right.select(*[F.col(k).alias(f"__r_{k}") if k in keys else F.col(k) for k in right.columns])
    on = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    return left.join(named, on, how).drop(*[f"__r_{k}" for k in keys])


def block_rows(alpha: float) -> int:
    """Rows after which a weight has faded below e**-40."""
    return max(2, math.ceil(40.0 / -math.log(1.0 - alpha)))


def exact_in(alpha: float, size: int) -> bool:
    """Whether the inverse weights of a block of ``size`` rows stay inside double range."""
    return -size * math.log(1.0 - alpha) < 650


def smoothing_reach(alpha: float) -> int:
    """Rows before a chunk that :meth:`Timeline.smooth` needs."""
    return 2 * block_rows(alpha)


def lay_out(
    df: DataFrame,
    keys: list[str] | str,
    order: list,
    slice_by: Column,
    back: int = 0,
    ahead: int = 0,
    chunk_rows: int | None = None,
    even: bool = False,
    positions: bool = False,
    block: int = 0,
    gaps: bool = True,
) -> Timeline:
    """Split ``df`` into chunks per key along ``order`` (see the module text).

    ``slice_by`` must be non-decreasing along ``order``. Without a halo the slices themselves
    are the chunks, which saves the second exchange; ``even`` asks for chunks of bounded row
    count all the same. Without either, positions are only worked out when ``positions`` is set.
    NULL keys are keys like any other, and NULL order values come first.
    ``block`` names the block length smoothing will use: the chunks are then sorted by block and
    position once, and smoothing and plain windows share that sort. ``gaps`` False says that no value column has a NULL.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    size = chunk_rows or int(df.sparkSession.conf.get(CHUNK_SETTING, str(CHUNK_ROWS)))
    plain = back == 0 and ahead == 0 and not even
    rows = df.withColumn(_SLICE, slice_by)
    if plain and not positions:
        return Timeline(rows, tuple(keys), (*keys, _SLICE), tuple(order), False)
    by_key = Window.partitionBy(*keys)
    starts = (
        rows.groupBy(*keys, _SLICE)
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumns(
            {
                "__tl_start": F.coalesce(
                    F.sum("__n").over(by_key.orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
                ),
                _TOTAL: F.sum("__n").over(by_key),
            }
        )
        .drop("__n")
    )
    local = Window.partitionBy(*keys, _SLICE).orderBy(*order)
    placed = (
        join_keys(rows, starts, [*keys, _SLICE])
        .withColumn(_POS, F.col("__tl_start") + F.row_number().over(local) - 1)
        .drop("__tl_start")
    )
    if plain:
        return Timeline(placed, tuple(keys), (*keys, _SLICE), tuple(order), False)
    spread = F.expr(
        f"explode(sequence(greatest({_POS} - {ahead}, 0L) div {size}, "
        f"least(({_POS} + {back}) div {size}, ({_TOTAL} - 1) div {size})))"
    )
    chunked = placed.drop(_SLICE).withColumn(_CHUNK, spread)
    chunked = chunked.withColumn(_OWN, F.col(_CHUNK) == F.expr(f"{_POS} div {size}"))
    if block:
        chunked = chunked.withColumn(_BLOCK, F.expr(f"{_POS} div {block}"))
        return Timeline(chunked, tuple(keys), (*keys, _CHUNK), (_BLOCK, _POS), True, block, gaps)
    return Timeline(chunked, tuple(keys), (*keys, _CHUNK), (_POS,), True)
