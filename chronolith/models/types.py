"""Model types that represent a group's values over an interval within a relative error bound.

A tick is the values of all members of a group at one time. All payloads are big-endian.
"""

from __future__ import annotations

import math
import struct

import numpy as np

NAN = float("nan")
#: Fixed value, for segments of equal length: per cent that make the whole of a value in the linear type's cone. A little over
#: 100, so that the rounding of the line to float32 stays inside the bound.
CONE = 100.1


def error(approx: float, real: float) -> float:
    """Percentage by which ``approx`` misses ``real``; infinite where real is 0 and approx isn't."""
    if approx == real:
        return 0.0
    return abs(real - approx) / abs(real) * 100.0 if real else math.inf


def f32(x: float) -> float:
    return float(np.float32(x))


class ModelType:
    """``append`` takes ticks until one can't be represented; ``payload`` gives the bytes for those taken."""

    name = ""

    def __init__(self, mtid: int, error_bound: float, length_bound: int):
        self.mtid, self.bound, self.limit = mtid, error_bound, length_bound
        self.clear()

    def clear(self) -> None:
        self.length, self.open = 0, True

    def start(self, buffer: list[tuple[int, tuple]]) -> None:
        """Begins anew on the buffered ticks."""
        self.clear()
        for ts, values in buffer:
            if not self.append(ts, values):
                break

    def append(self, ts: int, values: tuple) -> bool:
        raise NotImplementedError

    def payload(self) -> bytes:
        raise NotImplementedError

    def size(self) -> float:
        return len(self.payload()) if self.length else NAN

    def ratio(self, gaps: int) -> float:
        """Uncompressed bytes of a tick's time and value, over the segment's bytes."""
        return 16.0 * self.length / (24.0 + self.size() + 4.0 * gaps) if self.length else NAN

    @staticmethod
    def decode(payload: bytes, ticks: int, width: int, si: int) -> np.ndarray:
        """The values of all ticks, (ticks, width) of float32."""
        raise NotImplementedError


class Uncompressed(ModelType):
    """Takes everything up to the length bound: the fallback, always type 1."""

    name = "uncompressed"

    def clear(self) -> None:
        super().clear()
        self.values: list = []

    def append(self, ts: int, values: tuple) -> bool:
        if self.length >= self.limit:
            return False
        self.values.extend(values)
        self.length += 1
        return True

    def payload(self) -> bytes:
        return np.array(self.values, ">f4").tobytes()

    @staticmethod
    def decode(payload: bytes, ticks: int, width: int, si: int) -> np.ndarray:
        return np.frombuffer(payload, ">f4", ticks * width).astype(np.float32).reshape(ticks, width)


class PMCMean(ModelType):
    """One constant: the mean of all values, within the bound of their minimum and maximum."""

    name = "pmc_mean"

    def __init__(self, mtid: int, error_bound: float, length_bound: int):
        if not 0 <= error_bound <= 100:
            raise ValueError("the error bound must be between 0 and 100")
        super().__init__(mtid, error_bound, length_bound)

    def clear(self) -> None:
        super().clear()
        self.low, self.high, self.sum, self.count = math.inf, -math.inf, 0.0, 0

    def append(self, ts: int, values: tuple) -> bool:
        if not self.open:
            return False
        low, high = min(self.low, *values), max(self.high, *values)
        total, n = self.sum + sum(values), self.count + len(values)
        mean = f32(total / n)
        if error(mean, low) > self.bound or error(mean, high) > self.bound:
            self.open = False
            return False
        self.low, self.high, self.sum, self.count = low, high, total, n
        self.length += 1
        return True

    def payload(self) -> bytes:
        return struct.pack(">f", self.sum / self.count)

    @staticmethod
    def decode(payload: bytes, ticks: int, width: int, si: int) -> np.ndarray:
        return np.full((ticks, width), struct.unpack(">f", payload)[0], np.float32)


class Swing(ModelType):
    """One line through the first tick's mean, inside the cone that the later values leave.

    The payload is the slope per ms and the value at the segment's start; relative to the start the line keeps the
    digits that one over absolute times would lose.
    """

    name = "swing_filter"

    def __init__(self, mtid: int, error_bound: float, length_bound: int):
        if not 0 <= error_bound <= 100:
            raise ValueError("the error bound must be between 0 and 100")
        super().__init__(mtid, error_bound, length_bound)

    def clear(self) -> None:
        super().clear()
        self.taken: list[tuple[int, tuple]] = []
        self.upper = self.lower = None

    def append(self, ts: int, values: tuple) -> bool:
        if not self.open:
            return False
        if not self.length:
            mean = f32(sum(values) / len(values))
            if error(mean, min(values)) > self.bound or error(mean, max(values)) > self.bound:
                self.open = False
                return False
            self.t0, self.anchor = ts, mean
        else:
            dt, upper, lower = ts - self.t0, self.upper, self.lower
            for v in values:
                room = abs(v) * (self.bound / CONE)
                if upper is None:
                    upper, lower = (v + room - self.anchor) / dt, (v - room - self.anchor) / dt
                    continue
                u, l = self.anchor + upper * dt, self.anchor + lower * dt
                if u + room < v or l - room > v:
                    self.open = False
                    return False
                if u - room > v:
                    upper = (v + room - self.anchor) / dt
                if l + room < v:
                    lower = (v - room - self.anchor) / dt
            self.upper, self.lower = upper, lower
        self.taken.append((ts, values))
        self.length += 1
        return True

    def line(self) -> tuple[float, float]:
        return (0.0 if self.upper is None else (self.upper + self.lower) / 2), self.anchor

    def size(self) -> float:
        if self.length < 2:
            return NAN
        a, b = self.line()
        for ts, values in self.taken:
            x = f32(b + a * (ts - self.t0))
            if any(error(x, v) > self.bound for v in values):
                return NAN
        return len(self.payload())

    def payload(self) -> bytes:
        a, b = self.line()
        with np.errstate(over="ignore"):
            if f32(a) == a and f32(b) == b:
                return struct.pack(">ff", a, b)
            return struct.pack(">fd", a, b) if f32(a) == a else struct.pack(">dd", a, b)

    @staticmethod
    def coefficients(payload: bytes) -> tuple[float, float]:
        return struct.unpack({8: ">ff", 12: ">fd", 16: ">dd"}[len(payload)], payload)

    @staticmethod
    def decode(payload: bytes, ticks: int, width: int, si: int) -> np.ndarray:
        a, b = Swing.coefficients(payload)
        return np.repeat((b + a * (np.arange(ticks) * si)).astype(np.float32)[:, None], width, 1)


class Gorilla(ModelType):
    """Lossless: each value's bits XORed with those before, in a window of significant bits."""

    name = "gorilla"

    def clear(self) -> None:
        super().clear()
        self.bits: list[str] = []
        self.n_bits, self.prev = 0, None
        self.lead, self.trail = 33, 0

    def append(self, ts: int, values: tuple) -> bool:
        if self.length >= self.limit:
            return False
        for v in values:
            raw = int.from_bytes(struct.pack(">f", v), "big")
            if self.prev is None:
                self.put(f"{raw:032b}")
            elif raw == self.prev:
                self.put("0")
            else:
                x = raw ^ self.prev
                lead, trail = min(31, 32 - x.bit_length()), (x & -x).bit_length() - 1
                if lead >= self.lead and trail >= self.trail:
                    self.put("10" + f"{x >> self.trail:0{32 - self.lead - self.trail}b}")
                else:
                    n = 32 - lead - trail
                    self.put("11" + f"{lead:05b}{n:06b}{x >> trail:0{n}b}")
                    self.lead, self.trail = lead, trail
            self.prev = raw
        self.length += 1
        return True

    def put(self, bits: str) -> None:
        self.bits.append(bits)
        self.n_bits += len(bits)

    def size(self) -> float:
        return (self.n_bits + 7) // 8 if self.length else NAN

    def payload(self) -> bytes:
        n = (self.n_bits + 7) // 8
        return int("".join(self.bits).ljust(8 * n, "0"), 2).to_bytes(n, "big")

    @staticmethod
    def decode(payload: bytes, ticks: int, width: int, si: int) -> np.ndarray:
        count = ticks * width
        bits = bin(int.from_bytes(b"\1" + payload, "big"))[3:]
        out = np.empty(count, np.uint32)
        at, lead, trail = 32, 0, 0
        prev = int(bits[:32], 2) if count else 0
        for k in range(count):
            if k:
                if bits[at] == "0":
                    at += 1
                else:
                    if bits[at + 1] == "1":
                        lead, n = int(bits[at + 2 : at + 7], 2), int(bits[at + 7 : at + 13], 2) or 32
                        trail, at = 32 - lead - n, at + 13
                    else:
                        n, at = 32 - lead - trail, at + 2
                    prev ^= int(bits[at : at + n], 2) << trail
                    at += n
            out[k] = prev
        return out.view(np.float32).reshape(ticks, width)


#: Types by name; user-defined ones are added by ``register_model``.
REGISTRY: dict[str, type[ModelType]] = {c.name: c for c in (Uncompressed, PMCMean, Swing, Gorilla)}
FALLBACK = Uncompressed.name
DEFAULT = (PMCMean.name, Swing.name, Gorilla.name)


def register_model(cls: type[ModelType]) -> type[ModelType]:
    """Makes a user's model type known by its name."""
    REGISTRY[cls.name] = cls
    return cls


OWN = tuple(REGISTRY)


def user_types(names: tuple[str, ...]) -> dict[str, type[ModelType]]:
    """Classes of user-defined types among ``names``, to be sent to workers with the function that needs them."""
    return {n: REGISTRY[n] for n in names if n not in OWN}


def assign_mtids(names: tuple[str, ...]) -> dict[str, int]:
    """The fallback is 1, the others follow in order of first use. The fallback can't be listed."""
    if FALLBACK in names:
        raise ValueError("the fallback model type is always there and can't be listed")
    return {n: i + 1 for i, n in enumerate(dict.fromkeys((FALLBACK, *names)))}
