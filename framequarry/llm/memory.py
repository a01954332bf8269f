"""A worker's memory of results by key, bounded in bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterable

#: Bytes that an entry takes besides its key and value.
ENTRY_COST = 200


class Memory:
    """Values by key. Two generations: once the newer is over half of `most_bytes`, the older one is forgotten, but for
    what is looked up meanwhile; what one call of `known` asks for is there until the next."""

    def __init__(self, most_bytes: int):
        self.half, self.now, self.before, self.size = most_bytes // 2, {}, {}, 0

    def known(self, keys: Iterable, make: Callable[[list], Iterable], size: Callable = len) -> dict:
        """A dict that holds all `keys` at least; `make` gives the values of those that are new, in their order.

        `size` is a value's in bytes; a key counts as its value does.
        """
        if self.size > self.half:
            self.now, self.before, self.size = {}, self.now, 0
        fresh = [k for k in keys if k not in self.now]
        new = [k for k in fresh if k not in self.before]
        for k in fresh:
            if k in self.before:
                self.now[k] = self.before[k]
        self.now.update(zip(new, make(new)))
        self.size += ENTRY_COST * len(fresh) + 2 * sum(map(size, map(self.now.__getitem__, fresh)))
        return self.now
