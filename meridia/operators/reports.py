"""The health layer's evidence of every assessed trigger by numpy, over batches of whole entities.

assessment.health_evidence states what an item says and is made of; here a trigger's items are made where its
trends are. What says little is spelled out once for each way to say it; only amounts are spelled one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from meridia.operators import features as fe
from meridia.operators import health as ho
from meridia.operators import panels as pn
from meridia.operators import ratios as ro
from meridia.operators import slots as sl

CONCERNS = ("unknown", "elevated", "quiet")
UNKNOWN, ELEVATED, QUIET = range(3)
RATIOS = fe.RATIO_NAMES
CATEGORIES = tuple(r.category for r in ro.RATIOS)


def _keys() -> list[tuple[str, str, str | None, str | None]]:
    """Layer and kind, subject, dimension and code of each thing that the layer can say."""
    out = [("health:dimension_status", d, d, None) for d in fe.DIMENSIONS]
    out += [("health:ratio_trend", r, c, None) for r, c in zip(RATIOS, CATEGORIES, strict=True)]
    for names in ([ho.DETERIORATION_SIGNAL[r] for r in RATIOS], ["negative_equity"] * len(RATIOS), ["unusual_movement"] * len(RATIOS)):
        out += [("health:health_signal", f"{s}:{r}", c, s) for s, r, c in zip(names, RATIOS, CATEGORIES, strict=True)]
    out.append(("health:health_signal", "multi_dimension_deterioration:cross_dimension", None, "multi_dimension_deterioration"))
    out += [("health:ratio_change", r, None, None) for r in RATIOS]
    return [*out, ("data_quality:data_quality_caveat", "derived_inputs", None, None)]


_KEYS = _keys()
KEYS = tuple(f"{k}:{s}" for k, s, _, _ in _KEYS)
LAYERS, KINDS = (tuple(k.split(":")[i] for k, *_ in _KEYS) for i in (0, 1))
DIMENSIONS, CODES = (tuple(x[i] for x in _KEYS) for i in (2, 3))
# The places in KEYS that each kind begins at.
TREND = len(fe.DIMENSIONS)
SIGNAL = TREND + len(RATIOS)
CHANGE = SIGNAL + 3 * len(RATIOS) + 1
QUALITY = CHANGE + len(RATIOS)
ITEMS = pa.list_(pa.struct([("k", pa.int16()), ("concern", pa.int16()), ("evidence_id", pa.string()), ("summary", pa.string()), ("numbers", pa.list_(pa.float64()))]))
TAGS = {"dimension_status": "DS", "ratio_trend": "RT", "health_signal": "HS", "ratio_change": "RC", "data_quality_caveat": "DQ"}


def evidence_id(k: int, *content: str) -> str:
    text = "|".join((KEYS[k], *content))
    return f"EV-{TAGS[KINDS[k]]}-" + hashlib.blake2s(text.encode(), digest_size=4).hexdigest()


class Items:
    """Items by trigger: those of each kind are added, then sorted by trigger."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.ids: list[np.ndarray] = []
        self.told: list[np.ndarray] = []

    def add(self, trigger: np.ndarray, k: np.ndarray, concern: np.ndarray, said: list[tuple[str, str | None]], at: np.ndarray | None = None, numbers: np.ndarray | None = None, known: np.ndarray | None = None) -> None:
        """said: evidence_id and summary of each item, or of each way to say it, of which at tells the place; numbers those of an item, in known ones only."""
        ids, told = (np.array([x[i] for x in said], object) for i in (0, 1))
        at = np.arange(len(trigger)) if at is None else at
        self.ids.append(ids[at])
        self.told.append(told[at])
        numbers = np.zeros((len(trigger), 3)) if numbers is None else np.pad(numbers, ((0, 0), (0, 3 - numbers.shape[1])))
        n = np.zeros(len(trigger), int) if known is None else known
        self.parts.append((trigger, k, np.broadcast_to(concern, len(trigger)), numbers, n))

    def spelled(self, trigger: np.ndarray, k: np.ndarray, concern, say: Callable[[int, tuple[int, ...]], tuple[str, str]], *columns: np.ndarray) -> None:
        """Items that whole numbers of small range tell: each combination is spelled out once."""
        ways, at = np.unique(np.stack([k, *columns], axis=1), axis=0, return_inverse=True)
        self.add(trigger, k, concern, [say(int(w[0]), tuple(int(x) for x in w[1:])) for w in ways], at.reshape(-1))

    def lists(self, n: int) -> pa.ListArray:
        trigger, k, concern, numbers, some = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(trigger, kind="stable")
        numbers, some = numbers[order], some[order]
        told = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(some)].astype(np.int32)), pa.array(numbers[np.arange(3) < some[:, None]]))
        items = pa.StructArray.from_arrays(
            [pa.array(k[order].astype(np.int16)), pa.array(concern[order].astype(np.int16)), pa.array(np.concatenate(self.ids)[order], pa.string()), pa.array(np.concatenate(self.told)[order], pa.string()), told],
            ["k", "concern", "evidence_id", "summary", "numbers"],
        )
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(trigger, minlength=n))].astype(np.int32)), items)


def _names(mask: int) -> list[str]:
    return sorted(r for i, r in enumerate(RATIOS) if mask >> i & 1)


def health_items(v: pn.View) -> pa.ListArray:
    """The items of each trigger of a view."""
    v.ratios()
    t, out = pn.Trends(v), Items()
    n, k = len(v.last), len(RATIOS)
    year, bits = v.fy[v.last], 1 << np.arange(k)
    every = np.arange(n)
    worse, known = t.health == pn.WORSE, t.health >= pn.STABLE

    for d, name in enumerate(fe.DIMENSIONS):
        mine = np.array([c == name for c in CATEGORIES])

        def dimension(i: int, x: tuple[int, ...], name: str = name, size: int = int(mine.sum())) -> tuple[str, str]:
            status, label, sure, which = pn.DIMENSION_STATUSES[x[0]], f"FY{x[1]}", x[2], ", ".join(_names(x[3]))
            end = f"; deteriorating: {which})" if which else ")"
            return evidence_id(i, status, label, which), f"{name}: {status} over {label} ({sure} of {size} ratios conclusive{end}"

        status = t.dims[:, d].astype(int)
        out.spelled(every, np.full(n, d), np.array([ELEVATED, ELEVATED, QUIET, QUIET, UNKNOWN])[status], dimension, status, year, known[:, mine].sum(1), (worse & mine) @ bits)

    # Trends: those that have no amount are few ways to say so.
    concern = np.where(worse, ELEVATED, np.where(known, QUIET, UNKNOWN))
    told = t.conclusive & ~np.isnan(t.change)

    def trend(i: int, x: tuple[int, ...], amount: float | None = None) -> tuple[str, str]:
        health, direction, label = pn.HEALTHS[x[0]], pn.DIRECTIONS[x[1]], f"FY{x[2]}"
        text = f"{RATIOS[i - TREND]}: {health} ({direction}) across {x[3]} calculated period(s) in {label}"
        if amount is not None:
            text += f"; change {amount:+.4g}"
        if x[4] > 0:
            text += f"; {x[4]} consecutive period(s) same direction"
        return evidence_id(i, health, direction, label, "" if amount is None else f"{amount:.4g}"), text

    for some in (told, ~told & t.conclusive, ~t.conclusive):
        at, r = np.nonzero(some)
        columns = [x[at, r] for x in (t.health, t.direction)] + [year[at], t.n[at, r], t.persistence[at, r]]
        if some is told:
            amount = t.change[at, r]
            said = [trend(i, x, a) for i, a, *x in zip((r + TREND).tolist(), amount.tolist(), *(c.tolist() for c in columns), strict=True)]
            out.add(at, r + TREND, concern[at, r], said, None, amount[:, None], np.ones(len(at), int))
        elif some.any():
            nan = (t.conclusive & some)[at, r]
            ways, place = np.unique(np.stack([r + TREND, *columns], axis=1), axis=0, return_inverse=True)
            said = [trend(int(w[0]), tuple(int(x) for x in w[1:])) for w in ways]
            out.add(at, r + TREND, concern[at, r], said, place.reshape(-1), np.where(nan, np.nan, 0.0)[:, None], nan.astype(int))

    def signal(i: int, x: tuple[int, ...]) -> tuple[str, str]:
        ratio = KEYS[i].rpartition(":")[2]
        return evidence_id(i, f"FY{x[0]}"), CODES[i] + (f": {ratio}" if i < CHANGE - 1 else "")

    at, which = np.nonzero(np.concatenate([worse, t.negative, t.unusual, t.several[:, None]], axis=1))
    out.spelled(at, which + SIGNAL, ELEVATED, signal, year[at])

    # The newest change of a ratio within the window, between neighbouring periods.
    x, ok = v.windowed(v.ratio, 0.0), v.windowed(v.status == 0, False)
    years = v.windowed(np.repeat(v.fy[:, None], k, axis=1), 0)
    both = ok[:, 1:] & ok[:, :-1]
    at, r = np.nonzero(both.any(1))
    to = both.shape[1] - both[:, ::-1].argmax(1)[at, r]
    value, prior, fy = x[at, to, r], x[at, to - 1, r], years[at, to, r]
    with np.errstate(all="ignore"):
        amount = value - prior

    def change(i: int, a: float, y: int) -> tuple[str, str | None]:
        text = "" if a != a else f"{a:.4g}"
        return evidence_id(i, str(y), text), f"{RATIOS[i - CHANGE]} moved {text} to FY{y}" if text else None

    out.add(at, r + CHANGE, UNKNOWN, [change(*c) for c in zip((r + CHANGE).tolist(), amount.tolist(), fy.tolist(), strict=True)], None, np.stack([amount, prior, value], axis=1), np.full(len(at), 3))

    def quality(i: int, x: tuple[int, ...]) -> tuple[str, str]:
        names = _names(x[1])
        return evidence_id(i, f"FY{x[0]}", "|".join(names)), f"{len(names)} ratio(s) carry derived inputs: {', '.join(names)}"

    derived = np.logical_or.reduceat(v.from_derived, v.first, axis=0) @ bits
    at = np.flatnonzero(derived)
    out.spelled(at, np.full(len(at), QUALITY), UNKNOWN, quality, year[at], derived[at])
    return out.lists(n)


def report_rows(every: int):
    """Arrow batches of slots.entity_rows() to the report of each filing whose accession is divisible by every."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sl.entity_rows(batches):
            e = pn.Entities(batch)
            chosen = batch.column("accession").take(e.of).fill_null(1).to_numpy(zero_copy_only=False) % every == 0
            e.dated &= chosen
            left = set(e.of.filter(pa.array(chosen)).to_pylist())
            keys = {"entity": "accession", "as_of": "filed", "form": "form"}
            for v in e.views():
                left.difference_update(v.triggers.to_pylist())
                yield pa.RecordBatch.from_pydict({c: batch.column(x).take(v.triggers) for c, x in keys.items()} | {"fy": pa.array(v.fy[v.last].astype(np.int64)), "items": health_items(v)})
            if left:
                # Filings that see nothing are assessed as well.
                rows = pa.array(sorted(left))
                yield pa.RecordBatch.from_pydict({c: batch.column(x).take(rows) for c, x in keys.items()} | {"fy": pa.nulls(len(rows), pa.int64()), "items": pa.array([[]] * len(rows), ITEMS)})

    return run
