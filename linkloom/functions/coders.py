"""Range coder and the context-mixing byte coders that use it: PPM over a trained model, and PPM that learns as it goes."""

from __future__ import annotations

TOP, HALF, QUARTER = 1 << 32, 1 << 31, 1 << 30
MOST_COUNT = 65535


class CoderError(ValueError):
    """An interval, a model or a stream doesn't fit."""


def _checked(low: int, high: int, total: int) -> None:
    if total <= 0 or not 0 <= low < high <= total:
        raise CoderError(f"bad interval [{low}, {high}) of {total}")


class RangeEncoder:
    """Narrows a 32-bit interval; bits that both ends share go out, and those that straddle the middle wait."""

    def __init__(self) -> None:
        self.low, self.high, self.waiting, self.bits = 0, TOP - 1, 0, []

    def _out(self, bit: int) -> None:
        self.bits.append(bit)
        self.bits.extend([1 - bit] * self.waiting)
        self.waiting = 0

    def encode(self, low: int, high: int, total: int) -> None:
        _checked(low, high, total)
        size = self.high - self.low + 1
        a, b = self.low + size * low // total, self.low + size * high // total - 1
        if a > b:
            raise CoderError("the total is too large for the interval")
        while True:
            if b < HALF:
                self._out(0)
            elif a >= HALF:
                self._out(1)
                a, b = a - HALF, b - HALF
            elif a >= QUARTER and b < HALF + QUARTER:
                self.waiting += 1
                a, b = a - QUARTER, b - QUARTER
            else:
                break
            a, b = 2 * a, 2 * b + 1
        self.low, self.high = a, b

    def finish(self) -> bytes:
        """Two more bits settle the interval; the last byte is filled with zeros. Calls after the first give the same bytes."""
        bits = self.bits + ([0] + [1] * (self.waiting + 1) if self.low < QUARTER else [1] + [0] * (self.waiting + 1))
        size = (len(bits) + 7) // 8
        value = int("".join(map(str, bits)), 2) << (8 * size - len(bits))
        return value.to_bytes(size)


class RangeDecoder:
    def __init__(self, data: bytes):
        if not data:
            raise CoderError("no data")
        self.data, self.at, self.low, self.high, self.code = data, 0, 0, TOP - 1, 0
        for _ in range(32):
            self.code = 2 * self.code + self._bit()

    def _bit(self) -> int:
        """Zeros follow the end."""
        byte, k = divmod(self.at, 8)
        self.at += 1
        return self.data[byte] >> (7 - k) & 1 if byte < len(self.data) else 0

    def get(self, total: int) -> int:
        if total <= 0:
            raise CoderError("a total of 0")
        value = ((self.code - self.low + 1) * total - 1) // (self.high - self.low + 1)
        if not 0 <= value < total:
            raise CoderError("the stream doesn't fit")
        return value

    def decode(self, low: int, high: int, total: int) -> None:
        _checked(low, high, total)
        size = self.high - self.low + 1
        a, b, c = self.low + size * low // total, self.low + size * high // total - 1, self.code
        while True:
            if b < HALF:
                shift = 0
            elif a >= HALF:
                shift = HALF
            elif a >= QUARTER and b < HALF + QUARTER:
                shift = QUARTER
            else:
                break
            a, b, c = 2 * (a - shift), 2 * (b - shift) + 1, 2 * (c - shift) + self._bit()
        self.low, self.high, self.code = a, b, c


def _framed(data: bytes, payload: bytes) -> bytes:
    return len(data).to_bytes(4) + payload


def _unframed(stream: bytes) -> tuple[int, bytes]:
    if len(stream) < 5:
        raise CoderError("no length or no payload")
    n = int.from_bytes(stream[:4])
    if not n:
        raise CoderError("a length of 0")
    return n, stream[4:]


def _fitting(symbols: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Counts whose total, with an escape, is at most QUARTER: intervals are never narrower than that."""
    while sum(count for _, count in symbols) >= QUARTER:
        symbols = [(symbol, (count + 1) // 2) for symbol, count in symbols]
    return symbols


class StaticPPM:
    """A trained model: (order, last bytes as a number) -> symbols with counts, the most frequent first.

    A symbol is coded in the longest known context. A context that lacks it codes an escape, of count 1 after its symbols,
    and hands on to the next shorter one; after an escape of order 0, or without any context, the byte goes as it is.
    Counts of a context whose total would leave the coder's interval too narrow are halved, rounding up, until it doesn't.
    """

    def __init__(self, max_order: int, contexts: dict[tuple[int, int], list[tuple[int, int]]]):
        self.max_order, self.contexts = max_order, {}
        for key, symbols in contexts.items():
            places, at = {}, 0
            for symbol, count in _fitting(symbols):
                if count <= 0 or symbol in places:
                    raise CoderError("a count of 0, or a symbol twice")
                places[symbol] = at, at + count
                at += count
            self.contexts[key] = places, at

    def lookup(self, history: bytes, order: int) -> tuple[dict[int, tuple[int, int]], int] | None:
        return self.contexts.get((order, int.from_bytes(history[len(history) - order :]))) if order <= len(history) else None

    def best_context(self, history: bytes) -> int:
        """The highest order that has a context here; -1 if none has."""
        return next((o for o in range(min(self.max_order, len(history)), -1, -1) if self.lookup(history, o)), -1)

    @staticmethod
    def symbol_at(context: tuple[dict[int, tuple[int, int]], int], value: int) -> tuple[int, int, int]:
        for symbol, (low, high) in context[0].items():
            if low <= value < high:
                return symbol, low, high
        raise CoderError("no symbol there")

    def encode(self, data: bytes) -> bytes:
        if not data:
            raise CoderError("nothing to encode")
        out = RangeEncoder()
        for i, symbol in enumerate(data):
            history = data[max(0, i - self.max_order) : i]
            for order in range(len(history), -1, -1):
                context = self.lookup(history, order)
                if context is None:
                    continue
                places, total = context
                if symbol in places:
                    out.encode(*places[symbol], total + 1)
                    break
                out.encode(total, total + 1, total + 1)
            else:
                out.encode(symbol, symbol + 1, 256)
        return _framed(data, out.finish())

    def decode(self, stream: bytes) -> bytes:
        n, payload = _unframed(stream)
        r, out = RangeDecoder(payload), bytearray()
        for _ in range(n):
            history = bytes(out[max(0, len(out) - self.max_order) :])
            for order in range(len(history), -1, -1):
                context = self.lookup(history, order)
                if context is None:
                    continue
                total = context[1]
                value = r.get(total + 1)
                if value < total:
                    symbol, low, high = self.symbol_at(context, value)
                    r.decode(low, high, total + 1)
                    break
                r.decode(total, total + 1, total + 1)
            else:
                symbol = r.get(256)
                r.decode(symbol, symbol + 1, 256)
            out.append(symbol)
        return bytes(out)


class AdaptivePPM:
    """Counts of symbols after each history of up to MAX_ORDER bytes, updated after every byte on both sides.

    Symbols are laid out in byte order with an escape of count 1 behind them. A byte that the model has never met can't be
    coded. Counts are halved, rounding up, once a context's total reaches MOST_COUNT. Coding learns in a layer over the model,
    which holds the contexts that it has changed, so the model itself stays as it is and isn't copied.
    """

    MAX_ORDER = 4

    def __init__(self, contexts: dict[bytes, dict[int, int]] | None = None, below: AdaptivePPM | None = None):
        self.contexts: dict[bytes, dict[int, int]] = {k: dict(v) for k, v in (contexts or {}).items()}
        self.below = below

    def clone(self) -> AdaptivePPM:
        return AdaptivePPM(self.contexts, self.below)

    def counts(self, history: bytes) -> dict[int, int] | None:
        own = self.contexts.get(history)
        return self.below.counts(history) if own is None and self.below is not None else own

    def reset(self) -> None:
        self.contexts.clear()

    def context_count(self, order: int) -> int:
        return sum(len(k) == order for k in self.contexts)

    def _learn(self, history: bytes, symbol: int) -> None:
        for order in range(len(history) + 1):
            key = history[len(history) - order :]
            counts = self.contexts.get(key)
            if counts is None:
                counts = self.contexts[key] = dict(self.counts(key) or {})
            if counts.get(symbol, 0) >= MOST_COUNT:
                continue
            counts[symbol] = counts.get(symbol, 0) + 1
            if sum(counts.values()) >= MOST_COUNT:
                for k in counts:
                    counts[k] = (counts[k] + 1) // 2

    def update(self, data: bytes) -> None:
        for i, symbol in enumerate(data):
            self._learn(data[max(0, i - self.MAX_ORDER) : i], symbol)

    def encode(self, data: bytes) -> bytes:
        if not data:
            raise CoderError("nothing to encode")
        model, out = AdaptivePPM(below=self), RangeEncoder()
        for i, symbol in enumerate(data):
            history = data[max(0, i - self.MAX_ORDER) : i]
            for order in range(len(history), -1, -1):
                counts = model.counts(history[len(history) - order :])
                if not counts:
                    continue
                total = sum(counts.values())
                if symbol in counts:
                    low = sum(n for k, n in counts.items() if k < symbol)
                    out.encode(low, low + counts[symbol], total + 1)
                    break
                out.encode(total, total + 1, total + 1)
            else:
                raise CoderError(f"byte {symbol} isn't in the model")
            model._learn(history, symbol)
        return _framed(data, out.finish())

    def decode(self, stream: bytes) -> bytes:
        n, payload = _unframed(stream)
        model, r, out = AdaptivePPM(below=self), RangeDecoder(payload), bytearray()
        for _ in range(n):
            history = bytes(out[max(0, len(out) - self.MAX_ORDER) :])
            for order in range(len(history), -1, -1):
                counts = model.counts(history[len(history) - order :])
                if not counts:
                    continue
                total = sum(counts.values())
                value = r.get(total + 1)
                if value < total:
                    low = 0
                    for symbol in sorted(counts):
                        if value < low + counts[symbol]:
                            break
                        low += counts[symbol]
                    r.decode(low, low + counts[symbol], total + 1)
                    break
                r.decode(total, total + 1, total + 1)
            else:
                raise CoderError("an escape of order 0")
            model._learn(history, symbol)
            out.append(symbol)
        return bytes(out)
