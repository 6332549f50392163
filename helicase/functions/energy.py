"""Nearest-neighbour energies of RNA loops, in 0.01 kcal/mol at 37 C.

Pair types are CG GC GU UG AU UA (1 to 6) and 7 for two bases that don't pair;
bases are ACGU (1 to 4, T as U) and 0 for a gap or the end of the sequence.
"""

from __future__ import annotations

import functools
import math
import re
from dataclasses import dataclass

import numpy as np

INF = 10**8
MAX_LOOP = 30

# Measured loop energies that results must agree with.
STACK = [
    [-240, -330, -210, -140, -210, -210, 0],
    [-330, -340, -250, -150, -220, -240, 0],
    [-210, -250, 130, -50, -140, -130, 0],
    [-140, -150, -50, 30, -60, -100, 0],
    [-210, -220, -140, -60, -110, -90, 0],
    [-210, -240, -130, -100, -90, -130, 0],
    [0, 0, 0, 0, 0, 0, 0],
]
HAIRPIN = [
    INF, INF, INF, 570, 560, 560, 540, 590, 560, 640, 650, 660, 670, 678, 686, 694, 701, 707, 713, 719, 725,
    730, 735, 740, 744, 749, 753, 757, 761, 765, 769]
BULGE = [
    INF, 380, 280, 320, 360, 400, 440, 459, 470, 480, 490, 500, 510, 519, 527, 534, 541, 548, 554, 560, 565,
    571, 576, 580, 585, 589, 594, 598, 602, 605, 609]
INTERIOR = [
    INF, INF, 410, 510, 170, 180, 200, 220, 230, 240, 250, 260, 270, 278, 286, 294, 301, 307, 313, 319, 325,
    330, 335, 340, 345, 349, 353, 357, 361, 365, 369]
#: Hairpin mismatches by pair type: rows are the base after the 5' partner (A C G U), columns the one before the 3' partner (gap A C G U).
MISMATCH_HAIRPIN = {
    1: [[-90, -150, -150, -140, -180], [-90, -100, -90, -290, -80], [-90, -220, -200, -160, -110], [-90, -170, -140, -180, -200]],
    2: [[-70, -110, -150, -130, -210], [-70, -110, -70, -240, -50], [-70, -240, -290, -140, -120], [-70, -190, -100, -220, -150]],
    3: [[0, 20, -50, -30, -30], [0, -10, -20, -150, -20], [0, -90, -110, -30, 0], [0, -30, -30, -40, -110]],
    4: [[0, -50, -30, -60, -50], [0, -20, -10, -170, 0], [0, -80, -120, -30, -70], [0, -60, -10, -60, -80]],
    5: [[0, -30, -50, -30, -30], [0, -10, -20, -150, -20], [0, -110, -120, -20, 20], [0, -30, -30, -60, -110]],
    6: [[0, -50, -30, -60, -50], [0, -20, -10, -120, 0], [0, -140, -120, -70, -20], [0, -30, -10, -50, -80]],
}
#: Mismatches in interior loops by pair type: rows and columns are gap A C G U.
MISMATCH_INTERIOR = {
    1: [[0, 0, 0, 0, 0], [0, 0, 0, -110, 0], [0, 0, 0, 0, 0], [0, -110, 0, 0, 0], [0, 0, 0, 0, -70]],
    2: [[0, 0, 0, 0, 0], [0, 0, 0, -110, 0], [0, 0, 0, 0, 0], [0, -110, 0, 0, 0], [0, 0, 0, 0, -70]],
    3: [[0, 0, 0, 0, 0], [0, 70, 70, -40, 70], [0, 70, 70, 70, 70], [0, -40, 70, 70, 70], [0, 70, 70, 70, 0]],
    4: [[0, 0, 0, 0, 0], [0, 70, 70, -40, 70], [0, 70, 70, 70, 70], [0, -40, 70, 70, 70], [0, 70, 70, 70, 0]],
    5: [[0, 0, 0, 0, 0], [0, 70, 70, -40, 70], [0, 70, 70, 70, 70], [0, -40, 70, 70, 70], [0, 70, 70, 70, 0]],
    6: [[0, 0, 0, 0, 0], [0, 70, 70, -40, 70], [0, 70, 70, 70, 70], [0, -40, 70, 70, 70], [0, 70, 70, 70, 0]],
    7: [[90, 90, 90, 90, 90], [90, 90, 90, 90, -20], [90, 90, 90, 90, 90], [90, -20, 90, 90, 90], [90, 90, 90, 90, 20]],
}
#: Dangling bases A C G U on pair types 1 to 6.
DANGLE_5 = [[-50, -30, -20, -10], [-20, -30, 0, 0], [-30, -30, -40, -20], [-30, -10, -20, -20], [-30, -30, -40, -20], [-30, -10, -20, -20]]
DANGLE_3 = [[-110, -40, -130, -60], [-170, -80, -170, -120], [-70, -10, -70, -10], [-80, -50, -80, -60], [-70, -10, -70, -10], [-80, -50, -80, -60]]
TETRALOOPS = [
    "GGGGAC", "GGUGAC", "CGAAAG", "GGAGAC", "CGCAAG", "GGAAAC", "CGGAAG", "CUUCGG", "CGUGAG", "CGAAGG",
    "CUACGG", "GGCAAC", "CGCGAG", "UGAGAG", "CGAGAG", "AGAAAU", "CGUAAG", "CUAACG", "UGAAAG", "GGAAGC",
    "GGGAAC", "UGAAAA", "AGCAAU", "AGUAAU", "CGGGAG", "AGUGAU", "GGCGAC", "GGGAGC", "GUGAAC", "UGGAAA",
]
TETRALOOP_BONUS = [
    -300, -300, -300, -300, -300, -300, -300, -300, -300, -250, -250, -250, -250, -250, -200,
    -200, -200, -200, -200, -150, -150, -150, -150, -150, -150, -150, -150, -150, -150, -150,
]
MULTI_CLOSING, MULTI_STEM, WEAK_END = 340, 40, 50
NINIO, NINIO_MOST = 50, 300
LOG_SLOPE = 107.856

PAIR = np.zeros((5, 5), np.int8)
for _type, _bases in enumerate(["CG", "GC", "GU", "UG", "AU", "UA"], 1):
    PAIR["_ACGU".index(_bases[0]), "_ACGU".index(_bases[1])] = _type
#: The type of a pair read from its other end.
TURNED = np.array([0, 2, 1, 4, 3, 6, 5, 7], np.int8)


@dataclass(frozen=True)
class Energies:
    """Tables by pair type and base; ``int11``, ``int21`` and ``int22`` are those of small interior loops."""

    stack: np.ndarray
    mismatch_hairpin: np.ndarray
    mismatch_interior: np.ndarray
    dangle5: np.ndarray
    dangle3: np.ndarray
    int11: np.ndarray
    int21: np.ndarray
    int22: np.ndarray

    def hairpin(self, size: int) -> int:
        return HAIRPIN[size] if size <= 30 else HAIRPIN[30] + int(LOG_SLOPE * math.log(size / 30.0))


def _small_loops() -> dict[str, np.ndarray]:
    """Small interior loops by rule, where no measured tables are given: a start value and 70 for each weak pair."""
    weak = (np.arange(8) > 2).astype(np.int32) * 70
    ends = weak[:, None] + weak[None, :]
    return {
        "int11": np.broadcast_to((ends + 60)[:, :, None, None], (8, 8, 5, 5)).copy(),
        "int21": np.broadcast_to((ends + 240)[:, :, None, None, None], (8, 8, 5, 5, 5)).copy(),
        "int22": np.broadcast_to((ends + 110)[:, :, None, None, None, None], (8, 8, 5, 5, 5, 5)).copy(),
    }


@functools.lru_cache(maxsize=4)
def energies(text: str = "") -> Energies:
    """The built-in energies, with the tables that a parameter text names instead of the built-in ones.

    The text has sections: ``# int11`` (or another field's name), then all numbers
    of that table in order of its indices, separated by white space.
    """
    stack = np.zeros((8, 8), np.int32)
    stack[1:, 1:] = STACK
    hairpin = np.zeros((8, 5, 5), np.int32)
    for t, rows in MISMATCH_HAIRPIN.items():
        hairpin[t, 1:] = rows
    interior = np.zeros((8, 5, 5), np.int32)
    for t, rows in MISMATCH_INTERIOR.items():
        interior[t] = rows
    d5, d3 = np.zeros((8, 5), np.int32), np.zeros((8, 5), np.int32)
    d5[1:7, 1:], d3[1:7, 1:] = DANGLE_5, DANGLE_3
    tables = {"stack": stack, "mismatch_hairpin": hairpin, "mismatch_interior": interior, "dangle5": d5, "dangle3": d3, **_small_loops()}
    for name, body in re.findall(r"^#\s*(\w+)\s*$([^#]*)", text, re.M):
        if name not in tables:
            raise ValueError(f"no energy table is called {name}")
        tables[name] = np.array(body.split(), np.int32).reshape(tables[name].shape)
    return Energies(**tables)


@functools.cache
def tetraloop_bonus() -> dict[str, int]:
    return dict(zip(TETRALOOPS, TETRALOOP_BONUS))
