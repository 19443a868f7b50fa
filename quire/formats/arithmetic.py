"""Binary arithmetic decoders of T.82 (QM) and T.88 (MQ), integers and symbol numbers coded with them.

A decoder is a function ``bit(bank, context)``. A bank holds a state and its likelier symbol
for each context as one number, zero at the start.
"""

from __future__ import annotations

from collections.abc import Callable

#: Fixed values of T.82, Table 24, and of T.88, Table E.1, by number of state:
#: interval of the unlikelier symbol, state after it, state after the likelier one, exchange of symbols.
QM_STATES = """
    5a1d 1 1 1; 2586 14 2 0; 1114 16 3 0; 080b 18 4 0; 03d8 20 5 0; 01da 23 6 0; 00e5 25 7 0; 006f 28 8 0;
    0036 30 9 0; 001a 33 10 0; 000d 35 11 0; 0006 9 12 0; 0003 10 13 0; 0001 12 13 0; 5a7f 15 15 1; 3f25 36 16 0;
    2cf2 38 17 0; 207c 39 18 0; 17b9 40 19 0; 1182 42 20 0; 0cef 43 21 0; 09a1 45 22 0; 072f 46 23 0; 055c 48 24 0;
    0406 49 25 0; 0303 51 26 0; 0240 52 27 0; 01b1 54 28 0; 0144 56 29 0; 00f5 57 30 0; 00b7 59 31 0; 008a 60 32 0;
    0068 62 33 0; 004e 63 34 0; 003b 32 35 0; 002c 33 9 0; 5ae1 37 37 1; 484c 64 38 0; 3a0d 65 39 0; 2ef1 67 40 0;
    261f 68 41 0; 1f33 69 42 0; 19a8 70 43 0; 1518 72 44 0; 1177 73 45 0; 0e74 74 46 0; 0bfb 75 47 0; 09f8 77 48 0;
    0861 78 49 0; 0706 79 50 0; 05cd 48 51 0; 04de 50 52 0; 040f 50 53 0; 0363 51 54 0; 02d4 52 55 0; 025c 53 56 0;
    01f8 54 57 0; 01a4 55 58 0; 0160 56 59 0; 0125 57 60 0; 00f6 58 61 0; 00cb 59 62 0; 00ab 61 63 0; 008f 61 32 0;
    5b12 65 65 1; 4d04 80 66 0; 412c 81 67 0; 37d8 82 68 0; 2fe8 83 69 0; 293c 84 70 0; 2379 86 71 0; 1edf 87 72 0;
    1aa9 87 73 0; 174e 72 74 0; 1424 72 75 0; 119c 74 76 0; 0f6b 74 77 0; 0d51 75 78 0; 0bb6 77 79 0; 0a40 77 48 0;
    5832 80 81 1; 4d1c 88 82 0; 438e 89 83 0; 3bdd 90 84 0; 34ee 91 85 0; 2eae 92 86 0; 299a 93 87 0; 2516 86 71 0;
    5570 88 89 1; 4ca9 95 90 0; 44d9 96 91 0; 3e22 97 92 0; 3824 99 93 0; 32b4 99 94 0; 2e17 93 86 0; 56a8 95 96 1;
    4f46 101 97 0; 47e5 102 98 0; 41cf 103 99 0; 3c3d 104 100 0; 375e 99 93 0; 5231 105 102 0; 4c0f 106 103 0; 4639 107 104 0;
    415e 103 99 0; 5627 105 106 1; 50e7 108 107 0; 4b85 109 103 0; 5597 110 109 0; 504f 111 107 0; 5a10 110 111 1; 5522 112 109 0;
    59eb 112 111 1;
"""
MQ_STATES = """
    5601 1 1 1; 3401 6 2 0; 1801 9 3 0; 0ac1 12 4 0; 0521 29 5 0; 0221 33 38 0; 5601 6 7 1; 5401 14 8 0;
    4801 14 9 0; 3801 14 10 0; 3001 17 11 0; 2401 18 12 0; 1c01 20 13 0; 1601 21 29 0; 5601 14 15 1; 5401 14 16 0;
    5101 15 17 0; 4801 16 18 0; 3801 17 19 0; 3401 18 20 0; 3001 19 21 0; 2801 19 22 0; 2401 20 23 0; 2201 21 24 0;
    1c01 22 25 0; 1801 23 26 0; 1601 24 27 0; 1401 25 28 0; 1201 26 29 0; 1101 27 30 0; 0ac1 28 31 0; 09c1 29 32 0;
    08a1 30 33 0; 0521 31 34 0; 0441 32 35 0; 02a1 33 36 0; 0221 34 37 0; 0141 35 38 0; 0111 36 39 0; 0085 37 40 0;
    0049 38 41 0; 0025 39 42 0; 0015 40 43 0; 0009 41 44 0; 0005 42 45 0; 0001 43 45 0; 5601 46 46 0;
"""

Bit = Callable[[list, int], int]


def _steps(text: str) -> list[tuple[int, int, int]]:
    """(interval, next after the likelier symbol, next after the other) for each state and symbol."""
    rows = [(int(q, 16), int(lps), int(mps), int(x)) for q, lps, mps, x in (r.split() for r in text.split(";") if r.strip())]
    return [(q, 2 * mps + s, 2 * lps + (s ^ x)) for q, lps, mps, x in rows for s in (0, 1)]


QM_STEPS, MQ_STEPS = _steps(QM_STATES), _steps(MQ_STATES)


def qm(data: bytes) -> Bit:
    """Decodes bytes without stuffing; zeros follow their end."""
    steps, size, at = QM_STEPS, len(data), 3
    code = int.from_bytes(data[:3].ljust(3, b"\0"), "big") << 8
    interval, left = 0x10000, 8

    def bit(bank: list, context: int) -> int:
        nonlocal code, interval, left, at
        state = bank[context]
        qe, likely, other = steps[state]
        interval -= qe
        value = state & 1
        if code >> 16 < interval:
            if interval >= 0x8000:
                return value
            swap = interval < qe
        else:
            code -= interval << 16
            swap = interval >= qe
            interval = qe
        if swap:
            value ^= 1
            bank[context] = other
        else:
            bank[context] = likely
        while interval < 0x8000:
            interval <<= 1
            code <<= 1
            left -= 1
            if not left:
                code += (data[at] if at < size else 0) << 8
                at, left = at + 1, 8
        return value

    return bit


def mq(data: bytes) -> Bit:
    """Decodes a span that ends with the marker FF AC; ones follow it."""
    steps, size, at = MQ_STEPS, len(data), 0
    code, left, interval = (data[0] if data else 0xFF) << 16, 0, 0x8000

    def fill() -> None:
        nonlocal code, left, at
        after = data[at + 1] if at + 1 < size else 0xFF
        if at < size and data[at] != 0xFF:
            code += after << 8
            at, left = at + 1, 8
        elif after > 0x8F:
            code += 0xFF00
            left = 8
        else:
            code += after << 9
            at, left = at + 1, 7

    fill()
    code <<= 7
    left -= 7

    def bit(bank: list, context: int) -> int:
        nonlocal code, interval, left
        state = bank[context]
        qe, likely, other = steps[state]
        interval -= qe
        value = state & 1
        if code >> 16 < qe:
            swap = interval >= qe
            interval = qe
        else:
            code -= qe << 16
            if interval & 0x8000:
                return value
            swap = interval < qe
        if swap:
            value ^= 1
            bank[context] = other
        else:
            bank[context] = likely
        while interval < 0x8000:
            if not left:
                fill()
            interval <<= 1
            code = code << 1 & 0xFFFFFFFF
            left -= 1
        return value

    return bit


def closed(data: bytes) -> bool:
    """Whether a span for ``mq`` ends with its marker and has no other."""
    return data[-2:] == b"\xff\xac" and not any(data[k] == 0xFF and data[k + 1] > 0x8F for k in range(len(data) - 2))


#: Fixed values of T.88, Annex A: payload bits and first value of each range of integers.
RANGES = ((2, 0), (4, 4), (6, 20), (8, 84), (12, 340), (32, 4436))


class Integers:
    """The integer procedures of a segment by name, each with contexts of its own."""

    def __init__(self, bit: Bit):
        self.bit, self.banks = bit, {}

    def read(self, name: str) -> int | None:
        """The next integer of a procedure; None is the value out of band."""
        bank, path = self.banks.setdefault(name, [0] * 512), 1

        def one() -> int:
            nonlocal path
            b = self.bit(bank, path)
            path = path << 1 | b if path < 256 else (path << 1 | b) & 511 | 256
            return b

        negative, place = one(), 0
        while place < len(RANGES) - 1 and one():
            place += 1
        count, first = RANGES[place]
        value = 0
        for _ in range(count):
            value = value << 1 | one()
        value += first
        return value if not negative else -value if value else None

    def symbol(self, length: int) -> int:
        """A symbol number of ``length`` bits."""
        bank, path = self.banks.setdefault(f"IAID{length}", [0] * (1 << length + 1)), 1
        for _ in range(length):
            path = path << 1 | self.bit(bank, path)
        return path - (1 << length)
