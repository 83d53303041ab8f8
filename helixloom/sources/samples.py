"""Small seeded data sets with a known truth, for trying the pipelines out."""

from __future__ import annotations

from collections.abc import Iterator

COMPLEMENT = str.maketrans("ACGT", "TGCA")


def mulberry32(seed: int) -> Iterator[float]:
    """The stream of the mulberry32 generator: a counter, mixed twice."""
    mask, state = 0xFFFFFFFF, seed & 0xFFFFFFFF
    while True:
        state = (state + 0x6D2B79F5) & mask
        t = (state ^ state >> 15) * (state | 1) & mask
        t = (t + ((t ^ t >> 7) * (t | 61) & mask) & mask) ^ t
        yield ((t ^ t >> 14) & mask) / (1 << 32)


def genome(length: int, gc: float = 0.507, seed: int = 42) -> str:
    draw = mulberry32(seed)
    return "".join(("G" if next(draw) < 0.5 else "C") if next(draw) < gc else ("A" if next(draw) < 0.5 else "T") for _ in range(length))


def mutated(seq: str, rate: float, draw: Iterator[float]) -> str:
    return "".join("ACGT"[int(next(draw) * 4)] if next(draw) < rate else c for c in seq)


def reads(count: int = 500, bases: int = 20_000, length: int = 1450, error: float = 0.08, seed: int = 42) -> list[tuple[str, str, str, str]]:
    """id, desc, seq, qual of reads of either strand, with errors and matching qualities."""
    source, draw, out = genome(bases, seed=seed), mulberry32(seed + 1000), []
    for k in range(count):
        n = max(180, int(length * (0.4 + 1.2 * next(draw))))
        at = int(next(draw) * max(1, bases - n))
        seq = source[at : at + n]
        seq = seq.translate(COMPLEMENT)[::-1] if next(draw) < 0.5 else seq
        seq = mutated(seq, error, draw)
        qual = "".join(chr(33 + 6 + int(next(draw) * 12)) for _ in seq)
        out.append((f"read_{k + 1:04d}", f"ch={1 + int(next(draw) * 512)}", seq, qual))
    return out


def alignment(taxa: int = 9, columns: int = 1200, seed: int = 11) -> list[tuple[str, str]]:
    """id, seq of taxa in a chain: neighbours are the closest."""
    draw, seq, out = mulberry32(seed), genome(columns, seed=seed), []
    for k in range(taxa):
        seq = mutated(seq, 0.04, draw)
        out.append((f"taxon_{k + 1}", seq))
    return out


def panel(samples: int = 56, genes: int = 48, causal: int = 2, seed: int = 7) -> tuple[list[tuple[str, str, bool]], list[tuple[str, bool, str]]]:
    """Presence rows (gene, sample, present) and trait rows (sample, is_case, stratum); the first genes follow the trait."""
    draw = mulberry32(seed)
    traits = [(f"S{k + 1:02d}", next(draw) < 0.5, f"clade_{1 + int(next(draw) * 5)}") for k in range(samples)]
    cells = [(f"gene_{g + 1:02d}", name, case != (next(draw) < 0.08) if g < causal else next(draw) < 0.4) for g in range(genes) for name, case, _ in traits]
    return cells, traits


def replicon(length: int = 64_000, motif: str = "GAATTCGCGAATTC", copies: int = 6, seed: int = 11) -> str:
    """A contig with planted copies of a motif at even distances."""
    seq, gap = genome(length, seed=seed), length // copies
    for k in range(copies):
        at = k * gap + gap // 2
        seq = seq[:at] + motif + seq[at + len(motif) :]
    return seq
