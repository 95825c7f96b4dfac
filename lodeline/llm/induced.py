"""External induced sorting of suffixes, with common-prefix values.

After Bingmann, Fischer and Osipov, "Inducing suffix and LCP arrays in external memory" (2013). The suffixes at leftmost
S positions are named by their substrings, which are sorted by distribution, and sorted through the reduced text, by
recursion. From them all L suffixes are induced in rising order and from those all S suffixes in falling order: a queue
ordered by (first character, place in the scan) holds the induced tuples. Places rise with time, so a queue is a run per
character, kept in memory up to a bound and appended to files beyond it, and read back in order. Two suffixes of one
bucket share one character more than the suffixes they were induced from, whose common prefix is the least value between
their places in the scan.

Memory is bounded by two numbers, whatever the length of the text: `memory`, rows of tuples held at once, and `arrays`,
bytes of arrays. A text whose arrays fit is worked in plain arrays; of a longer one the text, the scan, the seeds, names
and marks are kept in pages, the longest unused of which are written to files. Reduced texts of up to `base` names are
sorted in memory, longer ones by induction again. Common-prefix values are kept up to a cap of at most 255.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict, defaultdict
from collections.abc import Callable, Iterator

import numpy as np


class Spill:
    """Where arrays go when memory is full: files under a folder that executors share, or memory where none is given."""

    def __init__(self, folder: str | None):
        self.folder, self.names, self.written = folder, [], 0

    def write(self, arrays: list[np.ndarray]) -> Callable[[int, int], bytes]:
        """A reader of [from, to) bytes of the arrays laid end to end."""
        self.written += sum(a.nbytes for a in arrays)
        if self.folder is None:
            data = b"".join(a.tobytes() for a in arrays)
            return lambda a, b: data[a:b]
        from lodeline.llm.files import _system

        uri = f"{self.folder}/{uuid.uuid4().hex}"
        system, path = _system(uri)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(path, compression=None) as out:
            for a in arrays:
                out.write(a.tobytes())
        self.names.append((system, path))

        def read(a: int, b: int) -> bytes:
            with system.open_input_file(path) as f:
                return f.read_at(b - a, a)

        return read

    def clear(self) -> None:
        for system, path in self.names:
            system.delete_file(path)
        self.names = []


class Flat:
    """An array in memory."""

    def __init__(self, dtype, values: np.ndarray | None = None):
        self.n = 0 if values is None else len(values)
        self.a = np.empty(1 << 10, dtype) if values is None else values

    def __len__(self) -> int:
        return self.n

    @property
    def dtype(self):
        return self.a.dtype

    def append(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.a):
            more = np.empty(max(2 * len(self.a), self.n + len(values)), self.a.dtype)
            more[: self.n] = self.a[: self.n]
            self.a = more
        self.a[self.n : self.n + len(values)] = values
        self.n += len(values)

    def get(self, at: np.ndarray) -> np.ndarray:
        return self.a[: self.n][at]

    def put(self, at: np.ndarray, values) -> None:
        self.a[at] = values

    def part(self, a: int, b: int) -> np.ndarray:
        return self.a[a : min(b, self.n)]

    def least(self, at: np.ndarray) -> np.ndarray:
        """Least values behind each place and up to the next."""
        return np.minimum.reduceat(self.a[: at[-1] + 1], at[:-1] + 1)


class Pool:
    """Pages of arrays; beyond `budget` bytes the longest unused half goes to a file."""

    def __init__(self, spill: Spill, budget: int):
        self.spill, self.budget, self.used = spill, budget, 0
        self.held: OrderedDict[tuple[int, int], np.ndarray] = OrderedDict()
        self.changed: set[tuple[int, int]] = set()
        self.away: dict[tuple[int, int], tuple] = {}
        self.arrays = 0

    def page(self, key: tuple[int, int], dtype) -> np.ndarray:
        if key in self.held:
            self.held.move_to_end(key)
            return self.held[key]
        read, a, b = self.away[key]
        page = np.frombuffer(read(a, b), dtype).copy()
        self.keep(key, page)
        return page

    def keep(self, key: tuple[int, int], page: np.ndarray, changed: bool = False) -> None:
        self.used += page.nbytes - (self.held[key].nbytes if key in self.held else 0)
        self.held[key] = page
        self.held.move_to_end(key)
        if changed:
            self.changed.add(key)
        if self.used > self.budget and len(self.held) > 2:
            self._evict()

    def _evict(self) -> None:
        out, size = [], 0
        while self.used > self.budget // 2 and len(self.held) > 1:
            key, page = self.held.popitem(last=False)
            self.used -= page.nbytes
            if key in self.changed:
                out.append((key, page))
        if out:
            read = self.spill.write([p for _, p in out])
            for key, page in out:
                self.away[key] = (read, size, size + page.nbytes)
                size += page.nbytes
                self.changed.discard(key)


class Paged:
    """An array in a pool's pages."""

    def __init__(self, pool: Pool, dtype, bits: int = 15):
        self.pool, self.dtype, self.n, self.bits = pool, np.dtype(dtype), 0, bits
        self.id, pool.arrays = pool.arrays, pool.arrays + 1
        self.lows: list[int] = []

    def __len__(self) -> int:
        return self.n

    def append(self, values: np.ndarray) -> None:
        size, at = 1 << self.bits, 0
        while at < len(values):
            k, used = self.n >> self.bits, self.n & (size - 1)
            more = np.asarray(values[at : at + size - used], self.dtype)
            page = np.concatenate([self.pool.page((self.id, k), self.dtype), more]) if used else more.copy()
            self.pool.keep((self.id, k), page, True)
            low = int(more.min())
            if used:
                self.lows[k] = min(self.lows[k], low)
            else:
                self.lows.append(low)
            self.n += len(more)
            at += len(more)

    def _by_page(self, at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        pages = at >> self.bits
        by = np.argsort(pages, kind="stable")
        cut = np.flatnonzero(np.diff(pages[by])) + 1
        for sel in np.split(by, cut):
            if len(sel):
                yield int(pages[sel[0]]), sel

    def get(self, at: np.ndarray) -> np.ndarray:
        out, mask = np.empty(len(at), self.dtype), (1 << self.bits) - 1
        for k, sel in self._by_page(at):
            out[sel] = self.pool.page((self.id, k), self.dtype)[at[sel] & mask]
        return out

    def put(self, at: np.ndarray, values) -> None:
        values, mask = np.broadcast_to(values, len(at)), (1 << self.bits) - 1
        for k, sel in self._by_page(at):
            page = self.pool.page((self.id, k), self.dtype)
            page[at[sel] & mask] = values[sel]
            self.pool.changed.add((self.id, k))

    def part(self, a: int, b: int) -> np.ndarray:
        b, size = min(b, self.n), 1 << self.bits
        found = [self.pool.page((self.id, k), self.dtype)[max(a - k * size, 0) : b - k * size] for k in range(a >> self.bits, ((b - 1) >> self.bits) + 1)] if b > a else []
        return np.concatenate(found) if found else np.zeros(0, self.dtype)

    def least(self, at: np.ndarray) -> np.ndarray:
        """Least values behind each place and up to the next. Pages inside one stretch are not read."""
        out, size, ends = np.full(len(at) - 1, np.iinfo(np.int64).max), 1 << self.bits, at[1:]
        for k in range((int(at[0]) + 1) >> self.bits, (int(at[-1]) >> self.bits) + 1):
            s, e = k * size, min((k + 1) * size, int(at[-1]) + 1)
            i, j = int(np.searchsorted(ends, s)), min(int(np.searchsorted(ends, e - 1)), len(ends) - 1)
            if i == j and at[i] < s and e == (k + 1) * size:
                out[i] = min(out[i], self.lows[k])
                continue
            begin = np.maximum(at[i : j + 1] + 1, s)
            low = np.minimum.reduceat(self.pool.page((self.id, k), self.dtype)[: e - s], begin - s)
            out[i : j + 1] = np.minimum(out[i : j + 1], low)
        return out


class Arrays:
    """Makes arrays: plain ones where `need` bytes fit the budget, else pages of one pool."""

    def __init__(self, spill: Spill, budget: int, need: int):
        self.pool = None if need <= budget else Pool(spill, budget)
        # Pages are small enough for a pool of a few hundred.
        self.bits = max(6, min(15, (max(budget, 1) // 512).bit_length()))

    def new(self, dtype):
        return Flat(dtype) if self.pool is None else Paged(self.pool, dtype, self.bits)

    def filled(self, dtype, n: int, value=0, step: int = 1 << 16):
        out = self.new(dtype)
        for a in range(0, n, step):
            out.append(np.full(min(step, n - a), value, dtype))
        return out


class Buckets:
    """Per character a sequence of (place, position) rows, first in first out; beyond `most` rows on disk."""

    def __init__(self, spill: Spill, most: int):
        self.spill, self.most = spill, most
        self.mem: dict[int, list[np.ndarray]] = defaultdict(list)
        self.runs: dict[int, list] = defaultdict(list)
        self.held = 0

    def push(self, char: int, rows: np.ndarray) -> None:
        """rows: int32, shape (2, n)."""
        self.mem[char].append(rows)
        self.held += rows.shape[1]
        if self.held > self.most:
            self.flush()

    def push_mixed(self, chars: np.ndarray, rows: np.ndarray) -> None:
        """Rows with a character each, in order of their places."""
        by = np.argsort(chars, kind="stable")
        chars, rows = chars[by], rows[:, by]
        cut = np.flatnonzero(np.diff(chars)) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(chars)]):
            if b > a:
                self.push(int(chars[a]), rows[:, a:b])

    def flush(self) -> None:
        parts, at, plan = [], 0, []
        for char, found in self.mem.items():
            rows = np.ascontiguousarray(np.concatenate(found, axis=1))
            parts.append(rows)
            plan.append((char, at, at + rows.nbytes))
            at += rows.nbytes
        read = self.spill.write(parts)
        for char, a, b in plan:
            self.runs[char].append((read, a, b))
        self.mem.clear()
        self.held = 0

    def pop(self, char: int, backwards: bool = False) -> Iterator[np.ndarray]:
        """Chunks of a character's rows so far, each removed as it is given."""
        runs, mem = self.runs.pop(char, []), self.mem.pop(char, [])
        self.held -= sum(m.shape[1] for m in mem)
        chunks = [lambda r=r: np.frombuffer(r[0](r[1], r[2]), np.int32).reshape(2, -1) for r in runs]
        if mem:
            chunks.append(lambda: np.concatenate(mem, axis=1))
        for c in reversed(chunks) if backwards else chunks:
            rows = c()
            yield rows[:, ::-1] if backwards else rows


def _stars(t, arrays: Arrays, step: int):
    """Leftmost S positions, rising. The text is read from its end in blocks."""
    n, found = len(t), []
    after, after_s = None, False  # the character behind the block, and whether its position is S
    for b in range(n, 0, -step):
        a = max(0, b - step)
        x = t.part(a, b)
        ends = np.append(np.flatnonzero(x[1:] != x[:-1]), len(x) - 1)
        rising = np.zeros(len(ends), bool)
        rising[:-1] = x[ends[:-1]] < x[ends[:-1] + 1]
        # The last run goes on behind the block, or meets another character there; the last position of all is L.
        rising[-1] = after is not None and (after_s if x[-1] == after else x[-1] < after)
        is_s = np.repeat(rising, np.diff(ends, prepend=-1))
        here = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1 + a
        if after is not None and after_s and not is_s[-1]:
            found.append(np.array([b], np.int64))
        found.append(here)
        after, after_s = x[0], bool(is_s[0])
    out = arrays.new(np.int64)
    for part in reversed(found):
        out.append(part)
    return out


def common_prefix(t, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common-prefix lengths of suffix pairs, up to cap."""
    n = len(t)
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    if isinstance(t, Flat) and t.dtype == np.uint8:
        words = getattr(t, "words", None)
        if words is None:
            padded = np.concatenate([t.part(0, n), np.zeros(16, np.uint8)])
            words = t.words = np.ndarray((n + 8,), "<u8", padded.tobytes(), 0, (1,))
        while len(live):
            x = words[np.minimum(a[live] + out[live], n)] ^ words[np.minimum(b[live] + out[live], n)]
            low = x & (~x + np.uint64(1))
            out[live] += np.where(x == 0, 8, np.bitwise_count(low - np.uint64(1)) >> 3).astype(np.int64)
            live = live[(x == 0) & (out[live] < cap) & (np.maximum(a[live], b[live]) + out[live] < n)]
        return np.minimum(np.minimum(out, cap), n - np.maximum(a, b))
    while len(live):
        i, j = a[live] + out[live], b[live] + out[live]
        ok = (np.maximum(i, j) < n) & (out[live] < cap)
        live, i, j = live[ok], i[ok], j[ok]
        live = live[t.get(i) == t.get(j)]
        out[live] += 1
    return out


class Names:
    """Ranks of the substrings from each leftmost S position to the next, equal for equal ones.

    Substrings are compared by keys of a few characters. What fits in memory is sorted there; the rest is dealt to parts by
    keys between splitters, a part at a time in order, and a part of one key goes on with the next characters. The longer
    of two of which one begins the other is the smaller, so ends are padded with the largest character.
    """

    def __init__(self, t, star, spill: Spill, memory: int, arrays: Arrays):
        self.t, self.star, self.spill, self.memory = t, star, spill, max(memory, 4)
        self.width = 9 if t.dtype == np.uint8 else 31
        self.per, self.pad = 63 // self.width, (1 << self.width) - 1
        #: The key of a substring that has ended before.
        self.over = 0
        for _ in range(self.per):
            self.over = (self.over << self.width) | self.pad
        self.out = arrays.filled(np.int32, len(star))
        self.count = 0

    def _spans(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last position of each; the last one reaches the end of the text."""
        m, n = len(self.star), len(self.t)
        end = np.full(len(which), n, np.int64)
        inner = which + 1 < m
        end[inner] = self.star.get(which[inner] + 1)
        return self.star.get(which), end

    def keys(self, begin: np.ndarray, end: np.ndarray, step: int) -> np.ndarray:
        n, key = len(self.t), np.zeros(len(begin), np.int64)
        for j in range(self.per):
            at = begin + step + j
            char = np.where(at < n, self.t.get(np.minimum(at, n - 1)).astype(np.int64) + 1, 0)
            key = (key << self.width) | np.where(at <= end, char, self.pad)
        return key

    def run(self) -> None:
        m = len(self.star)
        self._order(lambda: (np.arange(a, min(a + self.memory, m)) for a in range(0, m, self.memory)), m, 0)

    def _order(self, chunks: Callable[[], Iterator[np.ndarray]], size: int, step: int) -> None:
        """Name `size` places, given in chunks of their numbers, that agree on `step` characters."""
        if size <= self.memory:
            which = np.concatenate([*chunks(), np.zeros(0, np.int64)]).astype(np.int64)
            begin, end = self._spans(which)
            self._name(which, self._ranked(begin, end, step))
            return
        sample: list[np.ndarray] = []
        ended = True
        for which in chunks():
            begin, end = self._spans(which)
            key = self.keys(begin, end, step)
            ended &= bool((key == self.over).all())
            sample.append(np.unique(key[:: max(1, len(key) * 64 // self.memory)]))
        if ended:  # all are equal
            for which in chunks():
                self.out.put(which, self.count)
            self.count += 1
            return
        seen = np.unique(np.concatenate(sample))
        # A splitter opens a part; twice as many parts as are needed at least, each key alone where it is a splitter.
        parts = min(len(seen), 2 * (2 + size // self.memory), 512)
        split = seen[np.linspace(0, len(seen) - 1, parts).astype(int)]
        split = np.unique(np.concatenate([split, split + 1]))
        dealt, sizes, alone = Buckets(self.spill, self.memory), defaultdict(int), {}
        for which in chunks():
            begin, end = self._spans(which)
            key = self.keys(begin, end, step)
            part = np.searchsorted(split, key, side="right")
            for p in np.unique(part).tolist():
                own = key[part == p]
                lo, hi = int(own.min()), int(own.max())
                old = alone.get(p, (lo, hi))
                alone[p] = (min(lo, old[0]), max(hi, old[1]))
                sizes[p] += len(own)
            dealt.push_mixed(part, np.stack([which, which]).astype(np.int32))
        for p in sorted(sizes):
            rows = list(dealt.runs.pop(p, [])), dealt.mem.pop(p, [])
            dealt.held -= sum(x.shape[1] for x in rows[1])

            def again(rows=rows) -> Iterator[np.ndarray]:
                for read, a, b in rows[0]:
                    yield np.frombuffer(read(a, b), np.int32).reshape(2, -1)[0].astype(np.int64)
                for x in rows[1]:
                    yield x[0].astype(np.int64)

            one = alone[p][0] == alone[p][1]
            self._order(again, sizes[p], step + self.per if one else step)

    def _name(self, which: np.ndarray, rank: np.ndarray) -> None:
        values, dense = np.unique(rank, return_inverse=True)
        self.out.put(which, (self.count + dense).astype(np.int32))
        self.count += len(values)

    def _ranked(self, begin: np.ndarray, end: np.ndarray, step: int) -> np.ndarray:
        """Ranks of substrings that agree up to `step`, ties where they are equal."""
        m = len(begin)
        rank, todo = np.zeros(m, np.int64), np.arange(m)
        while len(todo):
            key = self.keys(begin[todo], end[todo], step)
            _, code = np.unique(key, return_inverse=True)
            # Ranks leave room: all of a tie's members share its first place, so refining it keeps the others' order.
            pair = np.lexsort((code, rank[todo]))
            r, c = rank[todo][pair], code[pair]
            new = np.append(True, r[1:] != r[:-1])
            diff = new | np.append(True, c[1:] != c[:-1])
            first = np.maximum.accumulate(np.where(new, np.arange(len(r)), 0))
            place = np.maximum.accumulate(np.where(diff, np.arange(len(r)), 0))
            rank[todo[pair]] = r + place - first
            step += self.per
            same = np.bincount(rank, minlength=m)
            todo = todo[(same[rank[todo]] > 1) & (begin[todo] + step <= end[todo])]
            # A tie that has ended for some goes on for the others; those that ended are larger and keep out of the way.
            ties = np.unique(rank[todo])
            todo = np.flatnonzero(np.isin(rank, ties)) if len(ties) else todo[:0]
        return rank


def _doubled(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a short text of names, by prefix doubling in memory."""
    m, rank, k = len(names), names.astype(np.int64), 1
    while True:
        key = rank * (m + 1)
        key[: m - k] += rank[k:] + 1 if k < m else 0
        uniq, rank = np.unique(key, return_inverse=True)
        if len(uniq) == m:
            return np.argsort(rank)
        k *= 2


class _Seeds:
    """Sorted seeds with their common prefixes, given by rising first character."""

    def __init__(self, t, seeds, lcps, most: int):
        self.t, self.seeds, self.lcps, self.most, self.at = t, seeds, lcps, max(most, 1), 0
        self._load()

    def _load(self) -> None:
        self.pos = self.seeds.part(self.at, self.at + self.most)
        self.lcp = self.lcps.part(self.at, self.at + self.most)
        self.char = self.t.get(self.pos) if len(self.pos) else self.pos
        self.k = 0

    def of(self, c: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        while len(self.pos):
            end = int(np.searchsorted(self.char, c, side="right"))
            if end > self.k:
                yield self.pos[self.k : end], self.lcp[self.k : end].astype(np.int64)
            self.k = end
            if end < len(self.pos):
                return
            self.at += len(self.pos)
            self._load()


#: Rows of tuples, bytes of arrays and names of a reduced text that a sort holds in memory.
MEMORY, ARRAYS, BASE = 1 << 19, 96 << 20, 4 << 20


def sorted_suffixes(t, cap: int, spill: Spill, *, memory: int = MEMORY, base: int = BASE, arrays: int = ARRAYS, depth: list | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, common prefix with the one before) of all suffixes, largest first, in chunks. t: an array or pages.

    depth: where given, the length of each reduced text that is sorted by induction is added to it.
    """
    t = Flat(None, t) if isinstance(t, np.ndarray) else t
    n = len(t)
    if not n:
        return
    if cap > 255 or n >= 1 << 31:
        raise ValueError("common prefixes are kept to 255, texts to 2**31 characters")
    room = Arrays(spill, arrays, n * (2 * t.dtype.itemsize + 8))
    step = max(memory, 64)
    star = _stars(t, room, max(step, 1 << 12))
    m = len(star)
    seeds, lcps = star, room.new(np.uint8)
    if m > 1:
        names = Names(t, star, spill, max(memory, base), room)
        names.run()
        order = room.filled(np.int32, m)
        if names.count == m:
            for a in range(0, m, step):
                order.put(names.out.part(a, a + step).astype(np.int64), np.arange(a, min(a + step, m)))
        elif m <= base:
            order = Flat(None, _doubled(names.out.part(0, m)))
        else:
            if depth is not None:
                depth.append(m)
            last = m
            for pos, _ in sorted_suffixes(names.out, 1, spill, memory=memory, base=base, arrays=arrays, depth=depth):
                order.put(np.arange(last - 1, last - 1 - len(pos), -1), pos)
                last -= len(pos)
        seeds = room.new(np.int64)
        for a in range(0, m, step):
            seeds.append(star.get(order.part(a, a + step).astype(np.int64)))
    last = np.zeros(0, np.int64)
    for a in range(0, m, step):
        part = np.concatenate([last, seeds.part(a, a + step)])
        lcp = common_prefix(t, part[:-1], part[1:], cap)
        lcps.append((lcp if a else np.append(0, lcp)).astype(np.uint8))
        last = part[-1:]
    if t.dtype == np.uint8:
        seen = np.zeros(256, bool)
        for a in range(0, n, 1 << 16):
            seen |= np.bincount(t.part(a, a + (1 << 16)), minlength=256).astype(bool)
        alphabet = np.flatnonzero(seen).tolist()
    else:
        # Names are dense.
        alphabet = range(max(int(t.part(a, a + (1 << 16)).max()) for a in range(0, n, 1 << 16)) + 1)

    def run_length(p: int) -> int:
        """How often the character at p stands there in a row."""
        x = t.part(p, p + cap)
        other = np.flatnonzero(x != x[0])
        return int(other[0]) if len(other) else len(x)

    def shared(scan, places: np.ndarray, before: int) -> np.ndarray:
        """1 + the least value of the scan after the place before and up to each place."""
        at = np.concatenate([[before], places])
        return np.minimum(scan.least(at).astype(np.int64) + 1, cap)

    def popped(queue: Buckets, scan, c: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """A bucket's induced suffixes with their common prefixes, those that it induces into itself included."""
        before, got = -1, True
        while got:
            got = False
            for rows in queue.pop(c):
                got = True
                places, pos = rows[0].astype(np.int64), rows[1].astype(np.int64)
                lcp = shared(scan, places, before) if before >= 0 else np.append(0, shared(scan, places[1:], int(places[0])) if len(places) > 1 else np.zeros(0, np.int64))
                before = int(places[-1])
                yield pos, lcp

    def induce(queue: Buckets, scan, pos: np.ndarray, lcp: np.ndarray, ok: Callable[[np.ndarray], np.ndarray]) -> None:
        """Put a bucket's next suffixes in the scan and what they induce in the queue."""
        here = np.arange(len(scan), len(scan) + len(pos))
        scan.append(lcp.astype(np.uint8))
        live = pos > 0
        at, pos = here[live], pos[live] - 1
        char = t.get(pos)
        fit = ok(char)
        if fit.any():
            queue.push_mixed(char[fit], np.stack([at[fit], pos[fit]]).astype(np.int32))

    # Rising scan: the end of the text, then each bucket's L part and its seeds.
    scan = room.new(np.uint8)
    scan.append(np.zeros(1, np.uint8))
    queue, done, given = Buckets(spill, memory), Buckets(spill, memory), _Seeds(t, seeds, lcps, memory)
    queue.push(int(t.part(n - 1, n)[0]), np.array([[0], [n - 1]], np.int32))
    for c in alphabet:
        end = -1
        for pos, lcp in popped(queue, scan, c):
            end = int(pos[-1])
            done.push(c, np.stack([lcp, pos]).astype(np.int32))
            induce(queue, scan, pos, lcp, lambda x: x >= c)
        for pos, lcp in given.of(c):
            if end is not None:
                lcp[0] = min(run_length(end), run_length(int(pos[0]))) if end >= 0 else 0
                end = None
            induce(queue, scan, pos, lcp, lambda x: x >= 0)
    # Falling scan: each bucket's S part, then its L part.
    scan = room.new(np.uint8)
    queue = Buckets(spill, memory)
    for c in reversed(alphabet):
        end = above = -1
        for pos, lcp in popped(queue, scan, c):
            end = int(pos[-1])
            yield pos, lcp
            induce(queue, scan, pos, lcp, lambda x: x <= c)
        for own, pos in done.pop(c, backwards=True):
            # A value is shared with the next smaller one; going down it belongs to the row after.
            pos, lcp = pos.astype(np.int64), np.append(0, own[:-1]).astype(np.int64)
            lcp[0] = above if above >= 0 else min(run_length(end), run_length(int(pos[0]))) if end >= 0 else 0
            above = int(own[-1])
            yield pos, lcp
            induce(queue, scan, pos, lcp, lambda x: x < c)


def repeated(t, counts, size: int, spill: Spill, **kw):
    """Marks of the positions that count (counts: 1, else 0) whose `size` characters also stand at an earlier one that
    counts. t, counts: arrays or pages; the marks are of the same kind."""
    t, counts = (Flat(None, x) if isinstance(x, np.ndarray) else x for x in (t, counts))
    room = Arrays(spill, kw.get("arrays", ARRAYS), 0 if isinstance(t, Flat) else 1 << 62)
    out = room.filled(np.uint8, len(t))
    low, gap = -1, 0  # the earliest position of the run that is open
    for pos, lcp in sorted_suffixes(t, size, spill, **kw):
        at = np.flatnonzero(counts.get(pos))
        if not len(at):
            gap = min(gap, int(lcp.min()))
            continue
        # Least value since the last suffix that counts, for each one that does.
        least = np.minimum.reduceat(lcp[: at[-1] + 1], np.concatenate([[0], at[:-1] + 1]))
        least[0] = min(int(least[0]), gap) if low >= 0 else 0
        gap = int(lcp[at[-1] + 1 :].min(initial=size))
        p = pos[at]
        start = np.flatnonzero(least < size)
        head = len(p) if not len(start) else int(start[0])
        if head:  # goes on with the run that is open
            out.put(p[:head], 1)
            if (first := int(p[:head].min())) < low:
                out.put(np.array([low]), 1)
                out.put(np.array([first]), 0)
                low = first
        if len(start):
            first = np.minimum.reduceat(p, start)
            run = np.cumsum(least < size)[head:] - 1
            hit = p[head:]
            out.put(hit[hit != first[run]], 1)
            low = int(p[int(start[-1]) :].min())
    return out
