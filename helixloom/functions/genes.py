"""Gene finding on one strand of one contig, in numpy: reading frames, ribosome sites, start choice."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Start codons with their usual shares, stop codons, the Shine-Dalgarno consensus.
STARTS = {"ATG": 0.42, "GTG": 0.34, "TTG": 0.24}
STOPS = ("TAA", "TAG", "TGA")
CONSENSUS = "TAAGGAGGT"
UPSTREAM = 22
CLAMP = 3.0


CODES = np.full(256, 4, np.int64)
CODES[[ord(c) for c in "ACGT"]] = range(4)


def codes(seq: str) -> np.ndarray:
    """A, C, G, T as 0 to 3, anything else 4."""
    return CODES[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]


def words(c: np.ndarray, k: int) -> np.ndarray:
    """Number of the k-mer at each place, -1 with an unknown base."""
    n = max(0, len(c) - k + 1)
    out, bad = np.zeros(n, np.int64), np.zeros(n, bool)
    for j in range(k):
        out = out * 4 + c[j : j + n]
        bad |= c[j : j + n] > 3
    return np.where(bad, -1, out)


def _number(word: str) -> int:
    return int(words(codes(word), len(word))[0])


STOP_CODES = np.array([_number(s) for s in STOPS])


def orfs(seq: str, least: int) -> list[tuple[int, int, bool]]:
    """start, end and open end of stretches between stops, by frame; the stop codon belongs to the stretch before it."""
    codon = words(codes(seq), 3)
    out = []
    for frame in range(3):
        ends = frame + 3 * np.flatnonzero(np.isin(codon[frame::3], STOP_CODES)) + 3
        starts = np.concatenate([[frame], ends]).astype(int)
        tail = starts[-1] + (len(seq) - starts[-1]) // 3 * 3
        stops = np.append(ends, tail).astype(int)
        kept = np.flatnonzero((stops - starts >= least) & (stops > starts))
        out += zip(starts[kept].tolist(), stops[kept].tolist(), (kept == len(ends)).tolist(), strict=True)
    return out


def ribosome_sites(c: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Score, matches, spacer (-1 without a site) and strong flag of the best site before each start; the first of equal sites."""
    n = len(CONSENSUS)
    motif = codes(CONSENSUS)
    width = UPSTREAM - n + 1
    fit = np.zeros(max(0, len(c) - n + 1), np.int64)
    for j in range(n):
        fit += c[j : j + len(fit)] == motif[j]
    padded = np.concatenate([np.full(width, -1), fit])
    # offsets from at - UPSTREAM to at - n; padding keeps those before the sequence out
    first = at - UPSTREAM
    grid = first[:, None] + np.arange(width) + width
    values = np.where(grid >= width, padded[np.clip(grid, 0, len(padded) - 1)] if len(padded) else -1, -1)
    values[grid - width + n > at[:, None]] = -1
    matches = values.max(1) if width else np.zeros(len(at), np.int64)
    offset = first + values.argmax(1)
    found = matches > 0
    spacer = np.where(found, at - offset - n, -1)
    score = np.clip((matches - 4) / 5, 0, 1) * np.where(spacer < 3, 0.55, np.where(spacer > 14, 0.6, np.where(spacer > 12, 0.85, 1.0)))
    score = np.where(found, np.floor(score * 1000 + 0.5) / 1000, 0.0)
    return score, np.maximum(matches, 0), spacer, found & (matches >= 7) & (spacer >= 4) & (spacer <= 13)


@dataclass
class CodingModel:
    log_odds: np.ndarray = field(default_factory=lambda: np.zeros(4096))
    usage: dict[str, float] = field(default_factory=lambda: dict(STARTS))
    genes: int = 0

    @property
    def trained(self) -> bool:
        return self.genes >= 30


def log_odds(coding: np.ndarray, background: np.ndarray) -> np.ndarray:
    """log2 ratio of hexamer shares with one pseudocount, clamped; 0 where neither was seen."""
    p, q = ((x + 1) / (x.sum() + len(x)) for x in (coding, background))
    return np.where((coding == 0) & (background == 0), 0.0, np.clip(np.log2(p / q), -CLAMP, CLAMP))


def best_site_start(orf: str) -> str | None:
    """The start codon with the best ribosome site; of equal ones the last ATG, else the first."""
    c = codes(orf)
    starts = {_number(s): s for s in STARTS}
    at = 3 * np.flatnonzero(np.isin(words(c, 3)[::3], list(starts)))
    at = at[at + 6 <= len(c)]
    if not len(at):
        return None
    score = ribosome_sites(c, at)[0]
    top = [starts[int(w)] for w in words(c, 3)[at[score == score.max()]]]
    return "ATG" if "ATG" in top else top[0]


def start_usage(found: dict[str, int]) -> dict[str, float]:
    n = sum(found.values())
    return dict(STARTS) if n < 20 else {s: 0.8 * found.get(s, 0) / n + 0.2 * prior for s, prior in STARTS.items()}


@dataclass
class Choice:
    rel: int
    codon: str
    total: float
    coding: float
    mean_lr: float
    rbs_score: float
    rbs_matches: int
    rbs_spacer: int | None


def choose_start(orf: str, model: CodingModel, use_rbs: bool = True, allowed: tuple[str, ...] = tuple(STARTS)) -> Choice | None:
    """The start of a reading frame by coding potential, ribosome site, codon usage and length; the first of equal ones."""
    c = codes(orf)
    codon = words(c, 3)[::3]
    starts = {_number(s): s for s in allowed}
    cell = np.flatnonzero(np.isin(codon, list(starts)))
    if not len(cell):
        return None
    hexamer = words(c, 6)[::3]
    gain = np.where(hexamer >= 0, model.log_odds[np.maximum(hexamer, 0)], 0.0)
    upto = np.concatenate([[0.0], np.cumsum(gain)])
    left = len(gain) - cell
    mean = np.where(left > 0, (upto[-1] - upto[np.minimum(cell, len(gain))]) / np.maximum(1, left), 0.0)
    coding = 1 / (1 + np.exp(-1.3 * mean))
    at = 3 * cell
    if use_rbs:
        score, matches, spacer, strong = ribosome_sites(c, at)
        weight, bonus = (1.0, 0.3) if model.trained else (1.2, 0.4)
    else:
        score, matches, spacer, strong = np.full(len(at), 0.35), np.zeros(len(at), int), np.full(len(at), -1), np.zeros(len(at), bool)
        weight = bonus = 0.0
    usage = np.array([model.usage.get(starts[int(w)], 0.33) for w in codon[cell]])
    total = (0.9 if model.trained else 0.6) * coding + weight * score + bonus * strong + 0.5 * usage + 0.3 * np.minimum(1, (len(orf) - at) / 1200)
    k = int(total.argmax())
    return Choice(int(at[k]), starts[int(codon[cell[k]])], float(total[k]), float(coding[k]), float(mean[k]), float(score[k]), int(matches[k]), int(spacer[k]) if spacer[k] >= 0 else None)


@dataclass
class Starts:
    """Columns of the chosen starts of many reading frames; ``frame`` says of which."""

    frame: np.ndarray
    rel: np.ndarray
    codon: np.ndarray
    total: np.ndarray
    coding: np.ndarray
    mean_lr: np.ndarray
    rbs_score: np.ndarray
    rbs_matches: np.ndarray
    rbs_spacer: np.ndarray


def choose_starts(orfs: list[str], model: CodingModel, use_rbs: bool = True, allowed: tuple[str, ...] = tuple(STARTS)) -> Starts:
    """``choose_start`` of many frames at once, which run through each numpy call together; frames without a start are left out."""
    sizes = np.array([len(x) for x in orfs], np.int64)
    many = sizes // 3
    text = "".join(x[: n * 3] for x, n in zip(orfs, many.tolist(), strict=True))
    c = codes(text).astype(np.int8)
    upto = np.concatenate([[0], np.cumsum(many)])
    codon = np.where((c.reshape(-1, 3) > 3).any(1), -1, c[::3].astype(np.int16) * 16 + c[1::3] * 4 + c[2::3])
    names = {_number(s): s for s in allowed}
    at = np.flatnonzero(np.isin(codon, list(names)))
    frame = np.searchsorted(upto, at, "right") - 1
    cell, last = at - upto[frame], upto[frame + 1] - 1
    # gain of each hexamer, summed within its frame alone
    gain = np.zeros(len(codon))
    gain[:-1] = np.where((codon[:-1] >= 0) & (codon[1:] >= 0), model.log_odds[np.maximum(codon[:-1].astype(np.int64) * 64 + codon[1:], 0)], 0.0)
    before = np.zeros(len(codon))  # the sum of a frame's gains before each codon; its last codon begins none
    for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True):
        if b - a > 1:
            np.cumsum(gain[a : b - 1], out=before[a + 1 : b])
    left = last - at
    mean = np.where(left > 0, (before[last] - before[at]) / np.maximum(1, left), 0.0)
    coding = 1 / (1 + np.exp(-1.3 * mean))
    if use_rbs:
        score, matches, spacer, strong = _sites(c, 3 * at, 3 * cell)
        weight, bonus = (1.0, 0.3) if model.trained else (1.2, 0.4)
    else:
        score, matches, spacer, strong = np.full(len(at), 0.35), np.zeros(len(at), int), np.full(len(at), -1), np.zeros(len(at), bool)
        weight = bonus = 0.0
    usage_of = np.zeros(64)
    usage_of[list(names)] = [model.usage.get(s, 0.33) for s in names.values()]
    usage = usage_of[codon[at]]
    total = (0.9 if model.trained else 0.6) * coding + weight * score + bonus * strong + 0.5 * usage + 0.3 * np.minimum(1, (sizes[frame] - 3 * cell) / 1200)
    first = np.flatnonzero(np.diff(frame, prepend=-1))  # the starts of a frame stand together
    best = np.maximum.reduceat(total, first) if len(first) else total
    top = np.flatnonzero(total == np.repeat(best, np.diff(np.append(first, len(total)))))
    k = top[np.flatnonzero(np.diff(frame[top], prepend=-1))]
    label = np.array([names.get(x, "") for x in range(64)], object)
    return Starts(frame[k], 3 * cell[k], label[codon[at[k]]], total[k], coding[k], mean[k], score[k], matches[k], spacer[k])


def _sites(c: np.ndarray, at: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``ribosome_sites`` before places of joined frames, of which each has ``room`` bases of its own frame before it."""
    n, motif = len(CONSENSUS), codes(CONSENSUS)
    fit = np.zeros(max(0, len(c) - n + 1), np.int8)
    for j in range(n):
        fit += c[j : j + len(fit)] == motif[j]
    back = np.arange(UPSTREAM, n - 1, -1)
    values = np.where(back <= room[:, None], fit[np.maximum(at[:, None] - back, 0)] if len(fit) else -1, np.int8(-1)).astype(np.int64)
    matches, pick = values.max(1, initial=-1), values.argmax(1)
    found = matches > 0
    spacer = np.where(found, back[pick] - n, -1)
    score = np.clip((matches - 4) / 5, 0, 1) * np.where(spacer < 3, 0.55, np.where(spacer > 14, 0.6, np.where(spacer > 12, 0.85, 1.0)))
    score = np.where(found, np.floor(score * 1000 + 0.5) / 1000, 0.0)
    return score, np.maximum(matches, 0), spacer, found & (matches >= 7) & (spacer >= 4) & (spacer <= 13)


def hexamer_counts(seq: str) -> np.ndarray:
    """How often each of the 4096 hexamers of A, C, G and T stands at any place."""
    w = words(codes(seq), 6)
    return np.bincount(w[w >= 0], minlength=4096)
