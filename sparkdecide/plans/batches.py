"""Sweeps over the models of many items at once, in numpy, within a task.

A batch holds small models as arrays padded to the largest: states x, stock levels y
and demands d of each item side by side. Items that have converged leave the arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Cells (items x levels x demands) of a batch, unless one item has more, and items at a time; small arrays stay in a core's cache.
CELLS, ROWS = 1 << 17, 1 << 9


class Rows:
    """Rows of a record batch: item, h, b, c, gamma, theta, x_min, x_max, demand (structs of d, p in order of d) and what a loop needs besides."""

    def __init__(self, batch: pa.RecordBatch):
        self.batch = batch

    def __len__(self) -> int:
        return self.batch.num_rows

    def __iter__(self) -> Iterator[dict]:
        return iter(self.batch.to_pylist())

    def column(self, name: str, kind: type = np.float64) -> np.ndarray:
        return self.batch[name].to_numpy(zero_copy_only=False).astype(kind)

    def sizes(self, name: str) -> np.ndarray:
        """Lengths of the lists of ``name``, 0 for nulls."""
        if name not in self.batch.schema.names:
            return np.zeros(len(self), np.int64)
        return self.batch[name].value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)

    def flat(self, name: str) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """For all elements of the lists of ``name``: the row they are of, their place in its list, and themselves."""
        size = self.sizes(name)
        row = np.repeat(np.arange(len(self)), size)
        return row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size), self.batch[name].flatten()


def _numbers(values: pa.Array, kind: type) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).astype(kind)


class Items:
    """Padded models of Rows, an item a column: states x, levels and demands go down.

    Next states of a demand are the values shifted by it, so a sweep gathers nothing unless demands lie far apart.
    """

    def __init__(self, rows: Rows, span: int):
        n = len(rows)
        self.span = span
        h, b, self.c, self.gamma, self.theta = (rows.column(k) for k in ("h", "b", "c", "gamma", "theta"))
        self.low, high = (rows.column(k, np.int64) for k in ("x_min", "x_max"))
        self.states = high - self.low + 1
        wide = int(self.states.max())
        owner, place, demand = rows.flat("demand")
        each, p = _numbers(demand.field("d"), np.int64), _numbers(demand.field("p"), np.float64)
        least, most, deep = int(each.min(initial=0)), int(each.max(initial=0)), int(place.max(initial=-1)) + 1
        self.dense = most - least < 2 * deep + 16
        if self.dense:  # row k is demand least + k
            self.least, self.d = least, None
            self.p = np.zeros((most - least + 1, n))
            np.add.at(self.p, (each - least, owner), p)
        else:
            self.least, self.d, self.p = 0, np.zeros((deep, n), np.int64), np.zeros((deep, n))
            self.d[place, owner], self.p[place, owner] = each, p
        self.x = self.low + np.arange(wide)[:, None]
        y = self.low + np.arange(wide + span)[:, None]
        cost = np.zeros(y.shape)
        for k in range(len(self.p)):
            left = y - self._demand(k)
            cost += (h * np.maximum(left, 0) + b * np.maximum(-left, 0)) * self.p[k]
        self.fixed = np.where(y <= high + span, -self.c * y - cost, -np.inf)
        self._frame()

    def _demand(self, k: int) -> int | np.ndarray:
        return self.least + k if self.dense else self.d[k]

    def _frame(self) -> None:
        """What follows from the items that are left."""
        self.wide = len(self.x)
        self.valid = np.arange(self.wide)[:, None] < self.states
        self.whole = bool(self.valid.all())
        self.ordered = self.c * self.x
        if self.dense:
            at = np.arange(len(self.fixed) + len(self.p) - 1) - (self.least + len(self.p) - 1)
            self.at, self.over = np.clip(at, 0, self.wide - 1), None if self.whole else at[:, None] > self.states - 1

    def some(self, rows: np.ndarray) -> Items:
        out = object.__new__(Items)
        out.span, out.dense, out.least = self.span, self.dense, self.least
        for k in ("c", "gamma", "theta", "low", "states"):
            setattr(out, k, getattr(self, k)[rows])
        for k in ("p", "x", "fixed", "d"):
            v = getattr(self, k)
            setattr(out, k, None if v is None else v[:, rows])
        out._frame()
        return out

    def action_values(self, v: np.ndarray) -> np.ndarray:
        """Value of having y on hand, without the part that depends on the state."""
        levels, deep = len(self.fixed), len(self.p)
        total = np.zeros(self.fixed.shape)
        if self.dense:
            ext = v[self.at]
            if self.over is not None:
                ext = np.where(self.over, v[self.states - 1, np.arange(v.shape[1])], ext)
            one = np.empty_like(total)
            for k in range(deep):
                total += np.multiply(ext[deep - 1 - k : deep - 1 - k + levels], self.p[k], out=one)
        else:
            for k in range(deep):
                to = np.clip(np.arange(levels)[:, None] - self.d[k], 0, self.states - 1)
                total += np.take_along_axis(v, to, axis=0) * self.p[k]
        total *= self.gamma
        total += self.fixed
        return total

    def _values(self, chosen: np.ndarray) -> np.ndarray:
        out = self.ordered + chosen + 0.0
        return out if self.whole else np.where(self.valid, out, 0.0)

    def best(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """New values and the best levels as offsets from the state; levels within 1e-9 are ties and the lowest wins.

        The best of two neighbouring stretches of levels is that of the left one, unless the right one's is more.
        """
        g = self.action_values(v)
        top, arg, have = np.round(g, 9), np.zeros(g.shape, np.int32), 1
        while have < self.span + 1:
            step = min(have, self.span + 1 - have)
            more = top[step:] > top[:-step]
            top, g, arg = (np.where(more, right, left) for right, left in ((top[step:], top[:-step]), (g[step:], g[:-step]), (arg[step:] + np.int32(step), arg[:-step])))
            have += step
        return self._values(g), arg.astype(np.int64)

    def under(self, policy: np.ndarray, v: np.ndarray) -> np.ndarray:
        """New values under a policy of offsets from the state."""
        return self._values(np.take_along_axis(self.action_values(v), np.arange(self.wide)[:, None] + policy, axis=0))


def swept(m: Items, v: np.ndarray, policy: np.ndarray | None, most: int, told: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list]:
    """(values, offsets, sweeps, converged, changes of each sweep if ``told``) of repeated sweeps, each item until its change
    is under its threshold; optimal ones, or under a fixed policy. Items that are done leave the arrays a quarter at a time."""
    n = v.shape[1]
    out, chosen = v.copy(), np.zeros(v.shape, np.int64) if policy is None else policy
    sweeps, converged, changes = np.zeros(n, np.int64), np.zeros(n, bool), [[] for _ in range(n)] if told else [None] * n
    open_, part, now, done, arg = np.arange(n), m, v, np.zeros(n, bool), None

    def keep(which: np.ndarray, k: int) -> None:
        at = open_[which]
        out[:, at], sweeps[at] = now[:, which], k
        if arg is not None:
            chosen[:, at] = arg[:, which]

    for k in range(1, most + 1):
        if policy is None:
            new, arg = part.best(now)
        else:
            new = part.under(policy[:, open_] if len(open_) < n else policy, now)
        delta, now = np.abs(new - now).max(axis=0), new
        if told:
            for i, d in zip(open_[~done].tolist(), delta[~done].tolist(), strict=True):
                changes[i].append(d)
        closed = (delta < part.theta) & ~done
        if closed.any():
            keep(closed, k)
            converged[open_[closed]] = True
            done |= closed
            if done.all():
                break
            if 4 * np.count_nonzero(done) >= len(done):
                part, now, open_ = part.some(~done), now[:, ~done], open_[~done]
                done = np.zeros(len(open_), bool)
    else:
        keep(~done, most)
    return out, chosen, sweeps, converged, changes


def iterated(m: Items, policy: np.ndarray, most: int, most_sweeps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(values, offsets, iterations, stable) of policy iteration; values carry over between iterations."""
    return _improved(m, policy, most, lambda part, at, v, chosen: swept(part, v, chosen, most_sweeps, False)[0])


def _improved(m: Items, policy: np.ndarray, most: int, valued) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Iterations of valued(models, their numbers, values, offsets) and improvement, each item until its policy stays."""
    n = policy.shape[1]
    v, policy = np.zeros(policy.shape), policy.copy()
    iterations, stable = np.zeros(n, np.int64), np.zeros(n, bool)
    open_ = np.arange(n)
    for k in range(1, most + 1):
        part = m.some(open_)
        v[:, open_] = valued(part, open_, v[:, open_], policy[:, open_])
        better = part.best(v[:, open_])[1]
        same = ((better == policy[:, open_]) | ~part.valid).all(axis=0)
        policy[:, open_], iterations[open_], stable[open_] = better, k, same
        open_ = open_[~same]
        if not len(open_):
            break
    return v, policy, iterations, stable


SOLVED = pa.schema([("item", pa.int64()), ("rounds", pa.int32()), ("done", pa.bool_()), ("states", pa.list_(pa.struct([("x", pa.int32()), ("value", pa.float64()), ("y", pa.int32())]))), ("changes", pa.list_(pa.float64()))])
SOLVED_DDL = "item bigint, rounds int, done boolean, states array<struct<x:int,value:double,y:int>>, changes array<double>"


def _chunks(b: pa.RecordBatch, span: int) -> Iterator[Rows]:
    for at in range(0, b.num_rows, ROWS):
        yield from _cut(Rows(b.slice(at, ROWS)), span)


def _cut(rows: Rows, span: int) -> Iterator[Rows]:
    wides = rows.column("x_max", np.int64) - rows.column("x_min", np.int64) + 1 + span
    deeps = np.maximum(rows.sizes("demand"), rows.sizes("history") // 4)
    begin = wide = deep = 0
    for k, (own_wide, own_deep) in enumerate(zip(wides.tolist(), deeps.tolist(), strict=True)):
        wide, deep = max(wide, own_wide), max(deep, own_deep)
        if k > begin and (k + 1 - begin) * wide * deep > CELLS:
            yield Rows(rows.batch.slice(begin, k - begin))
            begin, wide, deep = k, own_wide, own_deep
    if len(rows) > begin:
        yield Rows(rows.batch.slice(begin))


def _table(rows: Rows, name: str, field: str, m: Items, missing: np.ndarray) -> np.ndarray:
    """Values of ``field`` by state, from lists of structs; ``missing`` where an item has none."""
    out = missing.copy()
    if pa.types.is_list(rows.batch.schema.field(name).type):
        owner, _, of = rows.flat(name)
        at = _numbers(of.field("x"), np.int64) - m.low[owner]
        inside = (at >= 0) & (at < m.states[owner])
        out[at[inside], owner[inside]] = _numbers(of.field(field), out.dtype)[inside]
    return out


def _states(m: Items, v: np.ndarray, y: np.ndarray) -> pa.ListArray:
    """The states of each item, as flat columns under it."""
    some = m.valid.T
    flat = [pa.array(a.T[some], t) for a, t in ((m.x, pa.int32()), (v, pa.float64()), (m.x + y, pa.int32()))]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(m.states)]), pa.int32()), pa.StructArray.from_arrays(flat, ["x", "value", "y"]))


def _solved(rows: Rows, m: Items, v: np.ndarray, y: np.ndarray, rounds: np.ndarray, done: np.ndarray, changes: list) -> pa.RecordBatch:
    """Rows of SOLVED."""
    return pa.RecordBatch.from_arrays([rows.batch["item"].cast(pa.int64()), pa.array(rounds, pa.int32()), pa.array(done), _states(m, v, y), pa.array(changes, pa.list_(pa.float64()))], schema=SOLVED)


def solver(kind: str, span: int, most: int, most_sweeps: int = 0, told: bool = True):
    """mapInArrow over rows of item, parameters, demand, policy (structs of x, y) and start (structs of x, value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows in _chunks(b, span):
                m = Items(rows, span)
                # a state without an action orders nothing
                policy = None if kind == "values" else np.clip(_table(rows, "policy", "y", m, m.x) - m.x, 0, span)
                if kind == "iterate":
                    v, y, rounds, done = iterated(m, policy, most, most_sweeps)
                    changes = [None] * len(rows)
                else:
                    v, y, rounds, done, changes = swept(m, _table(rows, "start", "value", m, np.zeros(m.x.shape)), policy, most, told)
                yield _solved(rows, m, v, y, rounds, done, changes)

    return run


class Histories:
    """Real demand of the items of a batch, padded; rows with history (demands in order), h, b, c and terminal (structs of x, value)."""

    def __init__(self, rows: Rows, m: Items, x0: int, length: int, gamma: float):
        self.x0, self.length, self.gamma = x0, length, gamma
        self.n = rows.sizes("history")
        self.d = np.zeros((int(self.n.max(initial=0)), len(rows)), np.int64)
        owner, place, demand = rows.flat("history")
        self.d[place, owner] = _numbers(demand, np.int64)
        self.h, self.b = (rows.column(k) for k in ("h", "b"))
        self.terminal = _table(rows, "terminal", "value", m, np.zeros(m.x.shape))

    def some(self, rows: np.ndarray) -> Histories:
        out = object.__new__(Histories)
        out.x0, out.length, out.gamma = self.x0, self.length, self.gamma
        for k in ("n", "h", "b"):
            setattr(out, k, getattr(self, k)[rows])
        most = int(out.n.max(initial=0))
        out.d, out.terminal = self.d[:most, rows], self.terminal[:, rows]
        return out

    def values(self, m: Items, policy: np.ndarray) -> np.ndarray:
        """Mean return of each state's last visits in episodes of ``length`` periods, under a policy of offsets; 0 without visits."""
        periods, n = self.d.shape
        each, low, top, order = np.arange(n), m.low, m.states - 1, policy.ravel()
        at, reward, inside = np.zeros((periods + 1, n), np.int64), np.zeros((periods + 1, n)), np.ones((periods, n), bool)
        x = np.full(n, self.x0)
        for t in range(periods):  # all items take period t together
            there = x - low
            now = np.clip(there, 0, top)
            at[t], inside[t] = now * n + each, there == now
            y = low + now + order[at[t]]
            left = y - self.d[t]
            reward[t] = -(m.c * (y - x) + self.h * np.maximum(left, 0) + self.b * np.maximum(-left, 0))
            x = np.clip(left, low, low + top)
        # an item without periods may begin outside its states
        at[periods] = np.clip(x - low, 0, top) * n + each
        total, count, seen, g, at_end = np.zeros(policy.size), np.zeros(policy.size), np.full(policy.size, -1), np.zeros(n), self.terminal.ravel()
        for t in range(periods - 1, -1, -1):
            ends, episode, state = (t + 1 == self.n) | ((t + 1) % self.length == 0), t // self.length, at[t]
            g = np.where(ends, reward[t] + self.gamma * at_end[at[t + 1]], reward[t + 1] + self.gamma * g)
            new = (t < self.n) & inside[t] & (seen[state] != episode)
            total[state] += np.where(new, g, 0.0)
            count[state] += new
            seen[state] = np.where(t < self.n, episode, seen[state])
        return (total / np.maximum(count, 1) + 0.0).reshape(policy.shape)


def traced(m: Items, histories: Histories, policy: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(values, offsets, iterations, stable) of Monte Carlo policy iteration over real demand, each item until its policy stays."""
    return _improved(m, policy, most, lambda part, at, v, chosen: histories.some(at).values(part, chosen))


def tracer(span: int, most: int, x0: int, length: int, gamma: float):
    """mapInArrow over the rows of ``solver`` with history and terminal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows in _chunks(b, span):
                m = Items(rows, span)
                start = np.clip(_table(rows, "policy", "y", m, m.x) - m.x, 0, span)
                yield _solved(rows, m, *traced(m, Histories(rows, m, x0, length, gamma), start, most), [None] * len(rows))

    return run


def sweeper(span: int, sweeps: int):
    """mapInArrow over the rows of ``solver``: item, the states after so many optimality sweeps (one or more), and those after one less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows in _chunks(b, span):
                m = Items(rows, span)
                now, before = (_table(rows, "start", "value", m, np.zeros(m.x.shape)), None), None
                for _ in range(sweeps):
                    now, before = m.best(now[0]), now
                last = _states(m, *now)
                yield pa.RecordBatch.from_arrays([rows.batch["item"].cast(pa.int64()), last, _states(m, *before) if sweeps > 1 else pa.nulls(len(rows), last.type)], names=["item", "last", "before"])

    return run, f"item bigint, last {STATES_DDL}, before {STATES_DDL}"


STATES_DDL = "array<struct<x:int,value:double,y:int>>"


def together(kernels: dict[str, Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]]):
    """Several loops over the same rows: item and, in a column for each, the states it ends with. All have one span, so they cut rows alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for parts in zip(*(k(iter([b])) for k in kernels.values()), strict=True):
                yield pa.RecordBatch.from_arrays([parts[0]["item"], *(p["states"] for p in parts)], names=["item", *kernels])

    return run, ", ".join(["item bigint", *(f"`{k}` {STATES_DDL}" for k in kernels)])
