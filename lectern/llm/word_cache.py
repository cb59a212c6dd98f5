"""A bounded cache of computed words that keeps what is in use."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable, Sequence
from typing import Any


class WordCache:
    """Two generations: a full young one becomes the old one, from which words in use come back."""

    def __init__(self, compute: Callable[[list], Sequence], words: int) -> None:
        self.compute, self.words = compute, words
        self.young: dict[Hashable, Any] = {}
        self.old: dict[Hashable, Any] = {}

    def all_of(self, words: Iterable[Hashable]) -> Callable[[Hashable], Any]:
        """A lookup that knows all these words."""
        if len(self.young) > self.words:
            self.young, self.old = {}, self.young
        missing = set(words).difference(self.young)
        if self.old:
            back = missing.intersection(self.old)
            self.young.update((w, self.old[w]) for w in back)
            missing -= back
        if missing:
            new = list(missing)
            self.young.update(zip(new, self.compute(new), strict=True))
        return self.young.__getitem__
