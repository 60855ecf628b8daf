"""Slots of filing years by numpy: tag policies, derivation and gaps over dense matrices of a batch.

Rows are facts (keys of the filing, t, close, end, value) in order of accession: a row of the catalog's tags,
the filing's fiscal year-end as month * 100 + day, the day that the period ends and the amount. Whole
filings are taken together, FACTS facts at a time. Facts away from year-ends go. Matrices are filing years by tags, then by concepts; codes stand for words and are spelled out
by Spark. resolver.direct states the policies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from meridia.functions.scalars import FISCAL_YEAR_END_TOLERANCE_DAYS
from meridia.operators import catalog as ca

ABSENT, FOUND, DERIVED, CONFLICTING, MISSING = range(5)
HIGH, MEDIUM, LOW = 1, 2, 3
FACTS = 1 << 18
# A fact's code is its end, the place of its tag from 1 on, and its filing's year-end; a filing's own has its date and whether it has one.
CLOSE_BITS, DAY_BITS = 11, 20
TAGS = ca.tag_rows()
COLUMNS = {c.name: np.array([i for i, t in enumerate(TAGS) if t[1] == c.name], int) for c in ca.CONCEPTS}
PLACE = {c.name: i for i, c in enumerate(ca.CONCEPTS)}


def _formulas() -> tuple[list[str], dict[tuple[str, int], int], dict[str, np.ndarray]]:
    """All texts of formulas: tags, rules, and what components add up to by the tags used."""
    texts, rules, sums = [t[0] for t in TAGS], {}, {}
    for c in ca.CONCEPTS:
        for k, terms in enumerate(c.rules):
            rules[c.name, k] = len(texts)
            texts.append("".join(f" {'+' if sign > 0 else '-'} {name}" for sign, name in terms)[3:])
    for c in ca.CONCEPTS:
        if c.policy == ca.COMPONENTS:
            names = [TAGS[i][0] for i in COLUMNS[c.name]]
            sums[c.name] = np.arange(1 << len(names)) + len(texts)
            texts += [" + ".join(n for i, n in enumerate(names) if mask >> i & 1) for mask in range(1 << len(names))]
    return texts, rules, sums


FORMULAS, _RULES, _SUMS = _formulas()


class Slots:
    """Filing years by concepts: value and whether there is one, status, confidence, by_rule and formula."""

    def __init__(self, n: int, year: np.ndarray, tag: np.ndarray, value: np.ndarray, candidates: bool = False) -> None:
        shape = (n, len(ca.CONCEPTS))
        self.value, self.known = np.zeros(shape), np.zeros(shape, bool)
        self.status, self.confidence = np.zeros(shape, np.int8), np.full(shape, LOW, np.int8)
        self.by_rule, self.formula = np.zeros(shape, bool), np.full(shape, -1, np.int16)
        # (slot, place in its list, value) of candidates.
        self.candidates: list[tuple[np.ndarray, np.ndarray, np.ndarray]] | None = [] if candidates else None
        self._combine(n, year, tag, value)
        self._derive()
        self._fill()

    def _combine(self, n: int, year: np.ndarray, tag: np.ndarray, value: np.ndarray) -> None:
        key = year * len(TAGS) + tag
        order = np.lexsort((value, key))
        key, value = key[order], value[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | ((value[1:] != value[:-1]) & ~(np.isnan(value[1:]) & np.isnan(value[:-1])))
        key, value = key[new], value[new]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, int)
        has, several, low = np.zeros(n * len(TAGS), bool), np.zeros(n * len(TAGS), bool), np.zeros(n * len(TAGS))
        has[key[first]], low[key[first]] = True, value[first]
        several[key[first]] = np.diff(np.r_[first, len(key)]) > 1
        has, several, low = (x.reshape(n, -1) for x in (has, several, low))
        for c in ca.CONCEPTS:
            if len(COLUMNS[c.name]):
                self._direct(c, has[:, COLUMNS[c.name]], several[:, COLUMNS[c.name]], low[:, COLUMNS[c.name]], key, value)

    def _direct(self, c: ca.Concept, has: np.ndarray, several: np.ndarray, low: np.ndarray, key: np.ndarray, values: np.ndarray) -> None:
        at = np.flatnonzero(has.any(1))
        if not len(at):
            return
        has, several, low = has[at], several[at], low[at]
        row, col = np.arange(len(at)), COLUMNS[c.name]
        first = has.argmax(1)
        lead = low[row, first][:, None]
        others = has.copy()
        others[row, first] = False
        parts = c.policy == ca.COMPONENTS
        ambiguous = several.any(1)
        with np.errstate(invalid="ignore", over="ignore"):
            room = np.maximum(1.0, 0.001 * np.maximum(np.abs(lead), np.abs(low)))
            disagree = (others & ~((np.abs(lead - low) <= room) | np.isnan(room))).any(1) & (not parts)
        differ = others & (low != lead) & ~(np.isnan(low) & np.isnan(lead)) & (not parts)
        used = np.zeros_like(has)
        used[row, first] = True
        untagged = np.zeros(len(at), bool)
        if parts:
            grp, alt = np.array([TAGS[i][6] for i in col]), np.array([TAGS[i][7] for i in col])
            whole = grp[first] == 0
            n_groups = np.zeros(len(at), int)
            for g in range(1, grp.max() + 1):
                mine = has & (grp == g)
                least = np.where(mine, alt, len(alt)).min(1)
                used[~whole] = (used & ((grp != g) | (alt == least[:, None])) | (mine & (alt == least[:, None])))[~whole]
                n_groups += mine.any(1)
            untagged = ~whole & (n_groups < len(c.groups))
        summed = used.sum(1) > 1
        conflict = ambiguous | (disagree & (c.policy == ca.ALTERNATES))
        total = np.zeros(len(at))
        for i in range(len(col)):
            total = np.where(used[:, i], total + low[:, i], total)
        p = PLACE[c.name]
        self.value[at, p], self.known[at, p] = np.where(conflict, 0.0, total), ~conflict
        self.status[at, p] = np.where(conflict, CONFLICTING, np.where(summed, DERIVED, FOUND))
        rank = np.where((first > 0) | disagree, MEDIUM, HIGH)
        self.confidence[at, p] = np.where(conflict, LOW, np.where(summed | untagged, MEDIUM, HIGH) if parts else rank)
        self.by_rule[at, p] = summed & ~conflict
        text = col[first]
        if parts:
            text = np.where(summed, _SUMS[c.name][used @ (1 << np.arange(len(col)))], text)
        self.formula[at, p] = np.where(conflict, -1, text)
        if self.candidates is None:
            return
        slot = at * len(ca.CONCEPTS) + p
        if ambiguous.any():
            k = at[ambiguous] * len(TAGS) + col[several[ambiguous].argmax(1)]
            lo, hi = np.searchsorted(key, k), np.searchsorted(key, k, "right")
            place = np.arange((hi - lo).sum()) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
            self.candidates.append((np.repeat(slot[ambiguous], hi - lo), place, values[np.repeat(lo, hi - lo) + place]))
        listed = np.where((conflict & ~ambiguous)[:, None], has, differ & ~conflict[:, None])
        r, i = np.nonzero(listed)
        self.candidates.append((slot[r], i, low[r, i]))

    def _derive(self) -> None:
        # Derivations hang on each other two deep at most.
        for _ in range(3):
            value, known = self.value.copy(), self.known.copy()
            for c in ca.CONCEPTS:
                p = PLACE[c.name]
                for k, terms in enumerate(c.rules):
                    names = [PLACE[name] for _, name in terms]
                    ready = (self.status[:, p] == ABSENT) & known[:, names].all(1)
                    total = value[:, names[0]]
                    with np.errstate(invalid="ignore", over="ignore"):
                        for (sign, _), i in zip(terms[1:], names[1:], strict=True):
                            total = total + value[:, i] if sign > 0 else total - value[:, i]
                    self.value[ready, p], self.known[ready, p] = total[ready], True
                    self.status[ready, p], self.confidence[ready, p] = DERIVED, MEDIUM
                    self.by_rule[ready, p], self.formula[ready, p] = True, _RULES[c.name, k]

    def _fill(self) -> None:
        reported = self.reported
        natures, statements = (np.array([getattr(c, x) for c in ca.CONCEPTS]) for x in ("nature", "statement"))
        speaks = reported & ~np.isin([c.name for c in ca.CONCEPTS], ca.ROLL_FORWARD)
        for p in range(len(natures)):
            gap = (self.status[:, p] == ABSENT) & reported[:, natures == natures[p]].any(1) & speaks[:, statements == statements[p]].any(1)
            self.status[gap, p] = MISSING

    @property
    def reported(self) -> np.ndarray:
        """Slots that have tags."""
        return (self.status == FOUND) | (self.status == CONFLICTING) | ((self.status == DERIVED) & ~np.isin(self.formula, list(_RULES.values())))

    def candidate_lists(self, slots: np.ndarray) -> pa.ListArray:
        """The candidates of each of some slots, which are in order."""
        slot, place, value = (np.concatenate(x) for x in zip(*self.candidates, (np.empty(0, int), np.empty(0, int), np.empty(0)), strict=True))
        order = np.lexsort((place, slot))
        counts = np.bincount(slot, minlength=self.status.size)[slots]
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(value[order]))


def _near_year_end(end: np.ndarray, close: np.ndarray) -> np.ndarray:
    """Whether days lie about a fiscal year-end, month * 100 + day: scalars.day_distance over arrays, once for each pair."""
    low = int(end.min(initial=0))
    pairs, at = np.unique((end.astype(np.int64) - low) * 10000 + close, return_inverse=True)
    end, month, day = pairs // 10000 + low, pairs % 10000 // 100, pairs % 100
    year = end.astype("datetime64[D]").astype("datetime64[Y]").astype(int)
    near = np.zeros(len(end), bool)
    for k in (-1, 0, 1):
        first = (year + k) * 12 + month - 1
        last = (first + 1).astype("datetime64[M]").astype("datetime64[D]").astype(int) - 1
        closing = np.minimum(first.astype("datetime64[M]").astype("datetime64[D]").astype(int) + day - 1, last)
        near |= np.abs(end - closing) <= FISCAL_YEAR_END_TOLERANCE_DAYS
    return near[at]


def codes(column: pa.Array) -> np.ndarray:
    """Whole numbers that are equal where values, nulls included, are."""
    return column.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)


def whole(batches: Iterator[pa.RecordBatch], key: str, size: int = FACTS) -> Iterator[pa.RecordBatch]:
    """Rows that are in order of a key, in larger batches that divide no key: the last one's rows wait."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n < size:
            continue
        every = pa.concat_batches(held)
        code = codes(every.column(key))
        cut = int(np.flatnonzero(code != code[-1]).max(initial=-1)) + 1
        if cut:
            yield every.slice(0, cut)
        held, n = [every.slice(cut)], n - cut
        if n >= size:
            # A key of more rows than that: the next look is when they have doubled.
            size = 2 * n
    if n:
        yield pa.concat_batches(held)


def _slots(batch: pa.RecordBatch, candidates: bool = False) -> tuple[Slots, dict[str, pa.Array]]:
    """The slots of a batch of whole filings' facts and the keys of their years."""
    names = [c for c in batch.schema.names if c not in ("t", "close", "end", "value")]
    entity, accession = codes(batch.column("entity")), codes(batch.column("accession"))
    new = accession[1:] != accession[:-1]
    if (~new & (entity[1:] != entity[:-1])).any():
        order = pa.array(np.lexsort((entity, accession)))
        batch, entity, accession = batch.take(order), entity[order], accession[order]
        new = (accession[1:] != accession[:-1]) | (entity[1:] != entity[:-1])
    begin = np.r_[0, np.flatnonzero(new) + 1]
    filing = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(batch)]))
    tag, close, end, value = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("t", "close", "end", "value"))
    near = _near_year_end(end, close) & (tag >= 0)
    filing, tag, end, value = filing[near], tag[near].astype(int), end[near], value[near]
    fy = end.astype("datetime64[D]").astype("datetime64[Y]").astype(int) + 1970
    low = int(fy.min(initial=9999))
    span = int(fy.max(initial=low)) - low + 1
    years, at = np.unique(filing * span + fy - low, return_inverse=True)
    of = pa.array(begin[years // span])
    keys = {c: batch.column(c).take(of) for c in names} | {"fy": pa.array(years % span + low, pa.int64())}
    return Slots(len(years), at, tag, value, candidates), keys


def long_rows(candidates: bool):
    """Arrow batches of facts in order of accession to a row for each slot, in codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole(batches, "accession"):
            s, keys = _slots(batch, candidates)
            slots = np.flatnonzero(s.status != ABSENT)
            year, place = np.divmod(slots, len(ca.CONCEPTS))
            year = pa.array(year)
            columns = {c: x.take(year) for c, x in keys.items()} | {"c": pa.array(place.astype(np.int16)), "value": pa.array(s.value.ravel()[slots], mask=~s.known.ravel()[slots])}
            columns |= {n: pa.array(x.ravel()[slots].astype(np.int16)) for n, x in (("status", s.status), ("confidence", s.confidence), ("by_rule", s.by_rule), ("formula", s.formula))}
            if candidates:
                columns["candidates"] = s.candidate_lists(slots)
            yield pa.RecordBatch.from_pydict(columns)

    return run


def wide_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches of facts in order of accession to resolved values and their status codes, in catalog order."""
    for batch in whole(batches, "accession"):
        s, keys = _slots(batch)
        some = s.known.any(1)
        offsets = pa.array((np.arange(some.sum() + 1) * len(ca.CONCEPTS)).astype(np.int32))
        known = s.known[some].ravel()
        columns = {c: x.filter(pa.array(some)) for c, x in keys.items()}
        columns["values"] = pa.ListArray.from_arrays(offsets, pa.array(s.value[some].ravel(), mask=~known))
        columns["states"] = pa.ListArray.from_arrays(offsets, pa.array(s.status[some].ravel().astype(np.int16), mask=~known))
        columns["rules"] = pa.ListArray.from_arrays(offsets, pa.array(s.by_rule[some].ravel()))
        yield pa.RecordBatch.from_pydict(columns)


def packed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """wide_rows() with masks for states: known, derived and by_rule by concept, and all values, absent ones as 0."""
    bits = 1 << np.arange(len(ca.CONCEPTS))
    for batch in whole(batches, "accession"):
        s, keys = _slots(batch)
        some = s.known.any(1)
        columns = {c: x.filter(pa.array(some)) for c, x in keys.items()}
        for name, mask in (("known", s.known), ("derived", s.known & (s.status == DERIVED)), ("by_rule", s.known & s.by_rule)):
            columns[name] = pa.array((mask[some] @ bits).astype(np.int32))
        offsets = pa.array((np.arange(some.sum() + 1) * len(ca.CONCEPTS)).astype(np.int32))
        columns["value"] = pa.ListArray.from_arrays(offsets, pa.array(s.value[some].ravel()))
        yield pa.RecordBatch.from_pydict(columns)


def entity_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches of filings, each followed by its facts, in order within entities, to batches of whole ones as resolver.entity_years() has them."""
    for batch in whole(batches, "entity"):
        code = batch.column("code").to_numpy(zero_copy_only=False)
        day, tag, close = code >> DAY_BITS, (code >> CLOSE_BITS) % (1 << DAY_BITS - CLOSE_BITS) - 1, code % (1 << CLOSE_BITS)
        own = tag < 0
        keys = {c: batch.column(c) for c in ("entity", "accession")}
        filing = np.cumsum(own) - 1
        end = np.where(own, 0, day).astype(np.int32)
        facts = keys | {"at": pa.array(filing), "t": pa.array(tag.astype(np.int16)), "close": pa.array(np.where(own, 1231, close).astype(np.int16)), "end": pa.array(end), "value": batch.column("value")}
        s, years = _slots(pa.RecordBatch.from_pydict(facts))
        some = s.known.any(1)
        of, n = years["at"].to_numpy(zero_copy_only=False)[some], int(own.sum())
        bits = 1 << np.arange(len(ca.CONCEPTS))
        order = np.argsort(np.r_[np.arange(n) * 2, of * 2 + 1], kind="stable")
        row = pa.array(np.flatnonzero(own)[np.r_[np.arange(n), of][order]])
        # An own row has no values, so lists of years keep their order as they are sorted by filing and year.
        year = np.r_[np.full(n, -1), np.arange(len(of))][order]
        of_year = year >= 0
        at = year[of_year]
        columns = {c: batch.column(c).take(row) for c in ("entity", "accession", "form")}
        columns["filed"] = pa.array(day.astype(np.int32), mask=own & (close == 0)).take(row).cast(pa.date32())
        fy = np.zeros(len(order), np.int64)
        fy[of_year] = years["fy"].to_numpy(zero_copy_only=False)[some][at]
        columns["fy"] = pa.array(fy, mask=~of_year)
        for name, mask in (("known", s.known), ("derived", s.known & (s.status == DERIVED))):
            x = np.zeros(len(order), np.int32)
            x[of_year] = (mask[some] @ bits)[at]
            columns[name] = pa.array(x)
        offsets = np.r_[0, np.cumsum(of_year * len(ca.CONCEPTS))].astype(np.int32)
        columns["value"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(s.value[some][at].ravel()))
        yield pa.RecordBatch.from_pydict(columns)


CHECKS = (
    ("balance_sheet_equation", "total_assets"), ("cash_tie_out", "cash"), *(("sign_sanity", c) for c in ca.NON_NEGATIVE), *(("sign_sanity", f"{p} in {t}") for p, t in ca.PART_WHOLE),
)


def beyond(a: np.ndarray, b) -> np.ndarray:
    """a > b with NaN above every number, as Spark orders them."""
    return (a > b) | (np.isnan(a) & ~np.isnan(b))


def _checks(s: Slots, follows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(shown, passed, difference) of each of CHECKS by year; follows tells years whose row before is the year before."""
    value = {c: s.value[:, p] for c, p in PLACE.items()}
    known = {c: s.known[:, p] for c, p in PLACE.items()}

    def formula(c: str, text: str) -> np.ndarray:
        return (s.status[:, PLACE[c]] == DERIVED) & np.isin(s.formula[:, PLACE[c]], [i for i, x in enumerate(FORMULAS) if x == text])

    with np.errstate(all="ignore"):
        assets = value["total_assets"]
        gap = assets - (value["total_liabilities"] + value["total_equity"])
        # A side derived from the identity itself proves nothing.
        circular = formula("total_liabilities", "total_assets - total_equity") | formula("total_equity", "total_assets - total_liabilities")
        shown = known["total_assets"] & known["total_liabilities"] & known["total_equity"] & ~circular
        out = [(shown, ~beyond(np.abs(gap), np.maximum(1.0, 0.01 * np.abs(assets))), gap)]
        cash, flows = value["cash"], ("operating_cash_flow", "investing_cash_flow", "financing_cash_flow")
        prior = np.r_[np.zeros(1), cash][: len(cash)]
        shown = follows & known["cash"] & np.r_[np.zeros(1, bool), known["cash"]][: len(cash)]
        for c in flows:
            prior, shown = prior + value[c], shown & known[c]
        tie = cash - prior
        out.append((shown, ~beyond(np.abs(tie), np.maximum(10.0, 0.05 * np.abs(cash))), tie))
        never = np.zeros(len(cash), bool)
        out += [(known[c] & (value[c] < 0), never, value[c]) for c in ca.NON_NEGATIVE]
        out += [(known[p] & known[t] & beyond(value[p], 1.001 * value[t]), never, value[p] - value[t]) for p, t in ca.PART_WHOLE]
    return out


def check_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches of facts in order of accession to the checks of their years: place in CHECKS, passed, difference."""
    for batch in whole(batches, "accession"):
        s, keys = _slots(batch)
        fy, same = keys["fy"].to_numpy(zero_copy_only=False), [codes(keys[c]) for c in ("entity", "accession")]
        follows = np.zeros(len(fy), bool)
        follows[1:] = (np.diff(fy) == 1) & (same[0][1:] == same[0][:-1]) & (same[1][1:] == same[1][:-1])
        shown, passed, gap = (np.stack(x, axis=1) for x in zip(*_checks(s, follows), strict=True))
        year, check = np.nonzero(shown)
        at = pa.array(year)
        yield pa.RecordBatch.from_pydict({c: x.take(at) for c, x in keys.items()} | {"c": pa.array(check.astype(np.int16)), "passed": pa.array(passed[year, check]), "difference": pa.array(gap[year, check])})


def count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches of facts in order of accession to each accession's number of years."""
    for batch in whole(batches, "accession"):
        _, keys = _slots(batch)
        accession, fy = codes(keys["accession"]).astype(np.int64), keys["fy"].to_numpy(zero_copy_only=False)
        low = int(fy.min(initial=9999))
        span = int(fy.max(initial=low)) - low + 1
        years = np.unique(accession * span + fy - low) // span
        _, n = np.unique(years, return_counts=True)
        _, first = np.unique(accession, return_index=True)
        yield pa.RecordBatch.from_pydict({"accession": keys["accession"].take(pa.array(first)), "n_periods": pa.array(n.astype(np.int64))})


KINDS, VERDICTS = ("same_tag", "tag_change"), ("confirmed", "not_confirmed", "accession_absent")
SIDES = ("first", "restated")


def _adjacent(batch: pa.RecordBatch) -> np.ndarray:
    """The place of each row's filing: filings are rows side by side, and whole entities have theirs by date."""
    entity, accession = codes(batch.column("entity")), codes(batch.column("accession"))
    filed = batch.column("filed").cast(pa.int32()).to_numpy(zero_copy_only=False)
    turn = entity[1:] != entity[:-1]
    if turn.sum() != entity.max(initial=0) or (~turn & (filed[1:] < filed[:-1])).any():
        raise ValueError("facts are not in order of entity and filed")
    return np.r_[0, np.cumsum(turn | (filed[1:] != filed[:-1]) | (accession[1:] != accession[:-1]))]


def _restated(entity: np.ndarray, fy: np.ndarray, s: Slots) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(concept, row of the first filing, row of the first later one with another value) of slots as found; rows are in order of filings."""
    row, concept = np.nonzero((s.status == FOUND) & (s.formula >= 0) & (s.formula < len(TAGS)))
    low = int(fy.min(initial=9999))
    span = int(fy.max(initial=low)) - low + 1
    key = (entity[row].astype(np.int64) * span + fy[row] - low) * len(ca.CONCEPTS) + concept
    order = np.argsort(key, kind="stable")
    key, row, concept = key[order], row[order], concept[order]
    value = s.value[row, concept]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, int)
    lead = np.repeat(start, np.diff(np.r_[start, len(key)]))
    later = np.flatnonzero((value != value[lead]) & ~(np.isnan(value) & np.isnan(value[lead])))
    later = later[np.r_[True, lead[later][1:] != lead[later][:-1]]] if len(later) else later
    return concept[later], row[lead[later]], row[later]


def _reported(key: np.ndarray, value: np.ndarray, size: int, wanted: np.ndarray, claimed: np.ndarray, within: float) -> tuple[np.ndarray, ...]:
    """Of each wanted key's facts whether there are any, whether one is near the claimed value, and their least and greatest."""
    place = np.full(size, -1, np.int32)
    place[wanted] = np.arange(len(wanted))
    at = place[key]
    mine = at >= 0
    at, value = at[mine], value[mine]
    least, most, near = np.full(len(wanted), np.inf), np.full(len(wanted), -np.inf), np.zeros(len(wanted), bool)
    np.minimum.at(least, at, value)
    np.maximum.at(most, at, value)
    with np.errstate(invalid="ignore"):
        near[at[np.abs(value - claimed[at]) <= within]] = True
    return np.bincount(at, minlength=len(wanted)) > 0, near, least, most


def restatement_rows(names: tuple[str, ...], within: float):
    """Arrow batches of facts of whole entities, usable for slots or not, to some columns of their restatements, looked up again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole(batches, "entity"):
            yield pa.RecordBatch.from_pydict(_restatements(batch, names, within))

    return run


def _restatements(batch: pa.RecordBatch, names: tuple[str, ...], within: float) -> dict[str, pa.Array]:
    filing = _adjacent(batch)
    begin = np.flatnonzero(np.r_[True, filing[1:] != filing[:-1]])
    tag, close, end, value, usable = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("t", "close", "end", "value", "usable"))
    fy = end.astype("datetime64[D]").astype("datetime64[Y]").astype(int) + 1970
    low = int(fy.min())
    span = int(fy.max()) - low + 1
    cell = filing * span + fy - low
    some = np.zeros(len(begin) * span, bool)
    some[cell] = True
    years = np.flatnonzero(some)
    at = (np.cumsum(some) - 1)[cell]
    usable = np.flatnonzero(usable)
    usable = usable[_near_year_end(end[usable], close[usable])]
    s = Slots(len(years), at[usable], tag[usable].astype(int), value[usable])
    entity, year = codes(batch.column("entity"))[begin][years // span], years % span + low
    concept, *rows = _restated(entity, year, s)
    n = len(concept)
    of, place = np.concatenate(rows), np.r_[concept, concept]
    claimed, tags = s.value[of, place], s.formula[of, place].astype(int)
    found = _reported(at * len(TAGS) + tag, value, len(years) * len(TAGS), of * len(TAGS) + tags, claimed, within)
    (any_a, any_b), (near_a, near_b), (lo_a, lo_b), (hi_a, hi_b) = ((x[:n], x[n:]) for x in found)
    a, b = claimed[:n], claimed[n:]
    moved = tags[:n] != tags[n:]
    with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
        differs = beyond(hi_a - lo_b, within) | beyond(hi_b - lo_a, within)
        ratio = np.maximum(np.abs(a), np.abs(b)) / np.minimum(np.abs(a), np.abs(b))
        scale = (a != 0) & (b != 0) & ((np.abs(ratio - 1e3) < 10.0) | (np.abs(ratio - 1e6) < 1e4))
    holds = near_a & near_b & (moved | differs)
    columns = {"c": concept.astype(np.int16), "kind": moved.astype(np.int16), "verdict": np.where(any_a & any_b, np.where(holds, 0, 1), 2).astype(np.int16), "looks_like_scale_error": scale}
    columns |= {"fy": year[rows[0]]} | {f"{side}_{c}": x for side, v, t in zip(SIDES, (a, b), (tags[:n], tags[n:]), strict=True) for c, x in (("value", v), ("t", t.astype(np.int16)))}
    keys = {"entity": ("entity", rows[0])} | {f"{side}_accession": ("accession", r) for side, r in zip(SIDES, rows, strict=True)}
    return {c: batch.column(keys[c][0]).take(pa.array(begin[years[keys[c][1]] // span])) if c in keys else pa.array(columns[c]) for c in names}
