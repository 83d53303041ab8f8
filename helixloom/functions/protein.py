"""Properties of proteins: weight, charge, hydropathy, membrane helices, signal peptides."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np

#: Average residue masses, pKa values, Kyte-Doolittle hydropathy, small residues at cleavage sites.
RESIDUE_MASS = {
    "A": 71.0788, "R": 156.1875, "N": 114.1038, "D": 115.0886, "C": 103.1388, "E": 129.1155, "Q": 128.1307, "G": 57.0519, "H": 137.1411, "I": 113.1594,
    "L": 113.1594, "K": 128.1741, "M": 131.1926, "F": 147.1766, "P": 97.1167, "S": 87.0782, "T": 101.1051, "W": 186.2132, "Y": 163.1760, "V": 99.1326,
}
WATER, OTHER_MASS = 18.01524, 110.0
PKA_POSITIVE = {"N-terminus": 9.69, "K": 10.53, "R": 12.48, "H": 6.0}
PKA_NEGATIVE = {"C-terminus": 2.34, "C": 8.18, "D": 3.65, "E": 4.25, "Y": 10.07}
HYDROPATHY = {
    "A": 1.8, "R": -4.5, "N": -3.5, "D": -3.5, "C": 2.5, "Q": -3.5, "E": -3.5, "G": -0.4, "H": -3.2, "I": 4.5,
    "L": 3.8, "K": -3.9, "M": 1.9, "F": 2.8, "P": -1.6, "S": -0.8, "T": -0.7, "W": -0.9, "Y": -1.3, "V": 4.2,
}
SMALL = "AGSTCV"
BISECTIONS = 40


def rounded(x: float, digits: int) -> float:
    return math.floor(x * 10**digits + 0.5) / 10**digits


def molecular_weight(protein: str) -> float:
    return WATER + sum(n * RESIDUE_MASS.get(aa, OTHER_MASS) for aa, n in Counter(protein).items())


def isoelectric_point(protein: str) -> float | None:
    """The pH without net charge, by bisection between 0 and 14."""
    if not protein:
        return None
    n = Counter(protein) | {"N-terminus": 1, "C-terminus": 1}
    low, high = 0.0, 14.0
    for _ in range(BISECTIONS):
        ph = (low + high) / 2
        charge = sum(n[k] / (1 + 10 ** (ph - pka)) for k, pka in PKA_POSITIVE.items() if k in n) - sum(n[k] / (1 + 10 ** (pka - ph)) for k, pka in PKA_NEGATIVE.items() if k in n)
        low, high = (ph, high) if charge > 0 else (low, ph)
    return (low + high) / 2


def isoelectric_points(proteins: list[str]) -> list[float | None]:
    """``isoelectric_point`` of many proteins, all in one bisection."""
    low, high = np.zeros(len(proteins)), np.full(len(proteins), 14.0)
    sides = [[(pka, np.array([1 if len(k) > 1 else p.count(k) for p in proteins], float)) for k, pka in side.items()] for side in (PKA_POSITIVE, PKA_NEGATIVE)]
    for _ in range(BISECTIONS):
        ph = (low + high) / 2
        up, down = (sum(n / (1 + 10.0 ** (sign * (ph - pka))) for pka, n in side) for side, sign in zip(sides, (1, -1), strict=True))
        low, high = np.where(up > down, ph, low), np.where(up > down, high, ph)
    return [x if p else None for p, x in zip(proteins, ((low + high) / 2).tolist(), strict=True)]


def gravy(protein: str) -> float:
    return sum(n * HYDROPATHY.get(aa, 0.0) for aa, n in Counter(protein).items()) / len(protein) if protein else 0.0


def aromaticity(protein: str) -> float:
    return sum(map(protein.count, "FWY")) / len(protein) if protein else 0.0


def _tenths(protein: str) -> np.ndarray:
    """Hydropathy in whole tenths, so that sums at a threshold are exact."""
    return np.array([round(10 * HYDROPATHY.get(aa, 0.0)) for aa in protein], np.int64)


def membrane_segments(protein: str, window: int = 19, threshold: float = 1.6, least: int = 17, gap: int = 5) -> list[tuple[int, int]]:
    """1-based segments of windows with a high mean, merged over short gaps.

    A run that is closed by a low window ends one past its last window, one that reaches the end two past;
    these ends decide what is merged and kept.
    """
    if len(protein) < window:
        return []
    total = np.concatenate([[0], np.cumsum(_tenths(protein))])
    high = total[window:] - total[:-window] >= round(10 * threshold * window)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], high.astype(np.int8), [0]])))
    runs: list[list[int]] = []
    for start, stop in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        end = stop + window - 1
        if runs and start - runs[-1][1] <= gap:
            runs[-1][1] = end
        else:
            runs.append([start, end])
    return [(a + 1, b + 1) for a, b in runs if b - a + 1 >= least]


def signal_peptide(protein: str) -> tuple[float, int, str] | None:
    """Score, cleavage position and note: a charged start, a hydrophobic core and a cleavage site between small residues."""
    if len(protein) < 35:
        return None
    basic = sum(aa in "KR" for aa in protein[:8])
    total = np.concatenate([[0], np.cumsum(_tenths(protein[:40]))])
    core = max(int(total[s + 15] - total[s]) for s in range(2, min(10, len(protein) - 15) + 1)) / 150
    sites = (cut for cut in range(12, min(32, len(protein) - 2) + 1) if protein[cut - 3] in SMALL and protein[cut - 1] in SMALL)
    cut = next(sites, None)
    if basic < 2 or core < 1.4 or cut is None:
        return None
    score = 0.3 * min(1, basic / 3) + 0.45 * min(1, max(0, core - 1.4) / 1.1) + (0.25 if cut <= 26 else 0.12)
    return rounded(score, 2), cut, f"n-region +{basic} K/R · core mean KD {core:.2f} · predicted cleavage after residue {cut}"


def localization(segments: list, signal: tuple | None) -> str:
    if signal:
        return "secretory pathway (signal peptide detected)"
    if segments:
        return f"membrane ({len(segments)} TM helix{'es' if len(segments) > 1 else ''})"
    return "likely cytosolic"
