"""A deterministic tokenization automaton for byte-pair merges.

The automaton's labels are tokens; after label ``u`` only those labels ``v``
may follow for which merging would leave ``u v`` as they are. It starts as one
state per byte from which every byte leads on, and each merge ``(u, v) -> t``,
in rank order, is one gadget: the arc ``v`` out of the state after ``u`` is
taken away, an arc ``t`` is added wherever ``u`` and then ``v`` led on, and it
leads to a new state that has the arcs of the state after ``v`` at that time.

Written out, the arcs would be tokens squared. A gadget is kept instead as the
record (rank, left, right) of its merge, and an arc is looked up by undoing the
gadgets that made it, newest first; each answer is kept in a transition table.
A path through the automaton that spells a word is its encoding, and there is
exactly one. It is found byte by byte with a table of byte transitions (a trie
of the labels) that names the labels starting at each position, in time linear
in the length of the word.
"""

from __future__ import annotations

import base64

_NEVER = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a vocabulary file with a base64 token and a rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class TokenAutomaton:
    """Encodes bytes to token ids and back; picklable, bounded by its vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ids = dict(ranks)
        self.size = max(ranks.values(), default=-1) + 1
        self.labels: list[bytes] = [b""] * self.size
        for token, i in ranks.items():
            self.labels[i] = token
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("every byte must be a token")
        self.left = list(range(self.size))
        self.right = list(range(self.size))
        self.merged: dict[int, int] = {}
        self.table: dict[int, bool] = {}
        self.whole = [False] * self.size
        self.trie: dict[int, int] = {}
        self.accept: list[int] = [-1]
        # The gadgets, in rank order: all merges that a token's bytes go through come before its own.
        for token, i in sorted(ranks.items(), key=lambda kv: kv[1]):
            if len(token) == 1:
                self.whole[i] = True
            else:
                path = self._walk(token)
                if len(path) == 2:
                    u, v = path
                    self.left[i], self.right[i] = u, v
                    self.merged[u * self.size + v] = i
                    self.whole[i] = True
                    self.table.clear() if len(self.table) > 2_000_000 else self.table.pop(u * self.size + v, None)
            self._add(token, i)
        self.table.clear()

    @classmethod
    def restore(cls, state: dict) -> "TokenAutomaton":
        """The automaton that ``vars`` of another describes; plain values travel to workers without the package."""
        out = cls.__new__(cls)
        out.__dict__.update(state)
        out.table = {}
        return out

    def _add(self, token: bytes, i: int) -> None:
        node = 0
        for b in token:
            key = node << 8 | b
            node = self.trie.get(key, 0)
            if not node:
                node = self.trie[key] = len(self.accept)
                self.accept.append(-1)
        if self.whole[i]:
            self.accept[node] = i

    def follows(self, u: int, v: int) -> bool:
        """Whether arc ``v`` leaves the state after ``u``: the gadgets undone, newest first."""
        key = u * self.size + v
        known = self.table.get(key)
        if known is None:
            known = self.table[key] = self._arc(u, v)
        return known

    def _arc(self, u: int, v: int) -> bool:
        before = _NEVER  # only gadgets of a lower rank have been applied to the arc so far
        merged, n, left, right = self.merged, self.size, self.left, self.right
        while True:
            if merged.get(u * n + v, _NEVER) < before:
                return False  # its gadget took the arc away
            if u > v:
                # The state after u was copied from that after its right part by gadget u.
                if right[u] == u:
                    return True
                before, u = u, right[u]
            else:
                # The arc v was added by gadget v where its left part led on, unless the
                # same gadget had merged u with it already: the leftmost pair merges first.
                if left[v] == v:
                    if right[u] == u:
                        return True
                    before, u = u, right[u]
                else:
                    before, v = v + 1, left[v]

    def _walk(self, word: bytes) -> list[int]:
        trie, accept, follows = self.trie, self.accept, self.follows
        n = len(word)
        last = [-1] * (n + 1)
        start = [0] * (n + 1)
        for j in range(n):
            node, before = 0, last[j]
            if j and before < 0:
                continue
            for i in range(j, n):
                node = trie.get(node << 8 | word[i])
                if node is None:
                    break
                token = accept[node]
                if token >= 0 and last[i + 1] < 0 and (j == 0 or follows(before, token)):
                    last[i + 1], start[i + 1] = token, j
        out, i = [], n
        while i > 0:
            out.append(last[i])
            i = start[i]
        return out[::-1]

    def encode(self, word: bytes) -> list[int]:
        """The ids of one pre-split word; an empty word has none."""
        i = self.ids.get(word, -1)
        if i >= 0 and self.whole[i]:
            return [i]
        if len(self.table) > 4_000_000:
            self.table.clear()
        return self._walk(word)

    def decode(self, ids) -> bytes:
        """The labels along the path."""
        labels = self.labels
        return b"".join([labels[i] for i in ids])
