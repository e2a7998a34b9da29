"""BPE as a deterministic automaton whose arcs are tokens, compiled into flat tables.

The automaton starts with one state and one loop for each base symbol. Each merge (u, v) adds a gadget: the state p that
u leads to is copied without its arc v, u leads to the copy from now on, and every state with an arc u gets an arc uv to
where v led. After all merges a word has exactly one path whose labels spell it, and that path is its BPE encoding.

All arcs with one label lead to one state, so the automaton is a target state for each token and a row of arcs for each
state. A row is that of the state it was copied from, without one arc and without the arcs that this arc's left
descendants would have added later. Tokens are numbered so that what a gadget takes away is one run of numbers: in the
forest of left parts, children by age and then the parent. A compiled row is thus a sorted list of missing runs.

Labels are recognised by a second table, a deterministic string matcher over the symbols (a byte, or a byte that ends the
word): one transition a symbol, and for each of its states the longest label that ends there and the next shorter one.
All tables are complete before the first word and don't grow. Words are encoded in step, as numpy arrays over words.
"""

from __future__ import annotations

import json

import numpy as np

#: Symbols of words that go in step; bounds the arrays that encoding needs besides the tables.
STEP_SYMBOLS = 1 << 21


def byte_alphabet() -> dict[int, str]:
    """The printable character that byte-level vocabularies use for each byte (fixed rule)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class Automaton:
    """Compiled merges of a tokenizer file with an end-of-word suffix. A token that two merges make is an error."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str) -> None:
        self.labels = {i: t for t, i in vocab.items()}
        ids = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        self._gadgets(set(vocab.values()), ids)
        self._rows()
        self._matcher(vocab, suffix)

    def _gadgets(self, tokens: set[int], merges: list[tuple[int, int, int]]) -> None:
        """Target states of tokens, and for each state the one it was copied from and the run taken away."""
        made = {x for _, _, x in merges}
        if len(made) < len(merges):
            raise ValueError("two merges make one token")
        size = dict.fromkeys(tokens, 1)  # of the trees of left parts
        for u, _, x in reversed(merges):
            size[u] += size[x]
        self.target = dict.fromkeys(sorted(tokens - made), 0)
        first, at = {}, 0
        for t in self.target:
            first[t] = at
            at += size[t]
        used = dict.fromkeys(tokens, 0)
        copied, low, high = [-1], [0], [-1]  # state 0 is the start
        for u, v, x in merges:
            if u not in self.target or v not in self.target:
                continue
            state, arc = self.target[u], first[v] + size[v] - 1
            while state >= 0 and not low[state] <= arc <= high[state]:
                state = copied[state]
            if state >= 0:  # u is never followed by v
                continue
            before = self.target[v]
            copied.append(self.target[u])
            low.append(first[v] + used[v])
            high.append(arc)
            self.target[u] = len(copied) - 1
            self.target[x] = before
            first[x] = first[u] + used[u]
            used[u] += size[x]
        self._copied, self._run = np.array(copied), (np.array(low), np.array(high))
        self._place = {t: first[t] + size[t] - 1 for t in self.target}
        self._span = max(at, 1)

    def _rows(self) -> None:
        """The missing runs of every state that a token leads to, disjoint and sorted by (state, run)."""
        live = np.unique([0, *self.target.values()])
        number = np.zeros(len(self._copied), np.int64)
        number[live] = np.arange(len(live))
        own, state, parts = np.arange(len(live)), live, []
        while len(state):
            parts.append((own, self._run[0][state], self._run[1][state]))
            state = self._copied[state]
            own, state = own[state >= 0], state[state >= 0]
        own, low, high = (np.concatenate(x) for x in zip(*parts))
        low, high = own * self._span + low, own * self._span + high
        low, high = low[high >= low], high[high >= low]
        order = np.argsort(low, kind="stable")
        low, high = low[order], np.maximum.accumulate(high[order])
        begins = np.flatnonzero(np.concatenate([[True], low[1:] > high[:-1]])[: len(low)])
        # a run before all others keeps look-ups in bounds
        self.missing_from = np.concatenate([[-1], low[begins]])
        self.missing_to = np.concatenate([[-1], high[np.append(begins[1:], len(high)) - 1] if len(begins) else low])
        self.state_of = {t: int(number[s]) for t, s in self.target.items()}
        del self._copied, self._run

    def _matcher(self, vocab: dict[str, int], suffix: str) -> None:
        """The string matcher over symbols 0-255 (bytes) and 256-511 (the last byte of a word)."""
        unmap = {c: b for b, c in byte_alphabet().items()}
        spelt: list[tuple[int, list[int]]] = []
        for token, i in vocab.items():
            body, ends = (token[: -len(suffix)], True) if suffix and token.endswith(suffix) else (token, False)
            if i in self.target and body and all(c in unmap for c in body):
                symbols = [unmap[c] for c in body]
                symbols[-1] += 256 * ends
                spelt.append((i, symbols))
        n = np.array([len(s) for _, s in spelt], np.int64)
        flat = np.array([x for _, s in spelt for x in s], np.int64)
        begin = np.cumsum(n) - n
        # symbols in no longer label share a column: they lead to their own state alone
        common = np.unique(flat[np.repeat(n > 1, n)])
        self.column = np.full(512, len(common), np.int64)
        self.column[common] = np.arange(len(common))
        at, parents, symbols, levels = np.zeros(len(n), np.int64), [np.array([-1])], [np.array([-1])], [np.array([0])]
        size = 1
        for depth in range(int(n.max(initial=0))):
            going = np.flatnonzero(n > depth)
            key, inverse = np.unique(at[going] * 512 + flat[begin[going] + depth], return_inverse=True)
            at[going] = size + inverse
            parents.append(key >> 9)
            symbols.append(key & 511)
            levels.append(np.arange(size, size + len(key)))
            size += len(key)
        parent, symbol = np.concatenate(parents), np.concatenate(symbols)
        self.depth = np.repeat(np.arange(len(levels)), [len(x) for x in levels])
        token = np.full(size, -1, np.int64)
        token[at] = [i for i, _ in spelt]
        self.token, self.shorter, fall = token, np.full(size, -1, np.int64), np.zeros(size, np.int64)
        self.go = np.zeros((size, len(common) + 1), np.int32)
        self.single = np.zeros(512, np.int32)  # where a symbol leads from the start
        for depth, level in enumerate(levels[1:], 1):
            if depth == 1:
                self.single[symbol[level]] = level
                own = level[self.column[symbol[level]] < len(common)]
                self.go[0, self.column[symbol[own]]] = own
            else:
                fall[level] = self.go[fall[parent[level]], self.column[symbol[level]]]
            self.shorter[level] = np.where(token[fall[level]] >= 0, fall[level], self.shorter[fall[level]])
            self.go[level] = self.go[fall[level]]
            if depth < len(levels) - 1:
                child = levels[depth + 1]
                self.go[parent[child], self.column[symbol[child]]] = child
        self.longest = np.where(token >= 0, np.arange(size), self.shorter)
        known = token >= 0
        self.place, self.state = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.place[known] = [self._place[t] for t in token[known].tolist()]
        self.state[known] = [self.state_of[t] for t in token[known].tolist()]
        del self._place

    def has_arc(self, state: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether states have the arcs of the tokens with these places."""
        key = state * self._span + place
        return self.missing_to[np.searchsorted(self.missing_from, key, "right") - 1] < key

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The labels of the paths of pre-split words in UTF-8, one after another, and the n + 1 offsets of the words.

        An empty word has no labels. A word without a path raises ValueError.
        """
        n = np.array([len(w) for w in words], np.int64)
        order = np.argsort(-n, kind="stable")
        counts, parts, k = np.zeros(len(words), np.int64), [], 0
        while k < len(words):
            to = k + max(1, min(len(words) - k, STEP_SYMBOLS // max(int(n[order[k]]), 1)))
            own = order[k:to]
            ids, counts[own] = self._walk([words[i] for i in own.tolist()], n[own])
            parts.append(ids)
            k = to
        off = np.concatenate([[0], np.cumsum(counts)])
        out, flat = np.empty(off[-1], np.int64), np.concatenate(parts) if parts else np.zeros(0, np.int64)
        sizes = counts[order]
        out[np.arange(len(flat)) + np.repeat(off[order] - (np.cumsum(sizes) - sizes), sizes)] = flat
        return out, off

    def _walk(self, words: list[bytes], n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Labels and their number for words, the longest first."""
        symbol = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        begin = np.cumsum(n) - n
        symbol[(begin + n - 1)[n > 0]] += 256
        column, label = self.column[symbol], np.zeros(len(symbol), np.int64)  # 0: no label yet
        other = self.go.shape[1] - 1
        node = np.zeros(len(words), np.int64)
        for j in range(int(n.max(initial=0))):
            active = int(np.searchsorted(-n, -j, "left"))
            at = begin[:active] + j
            c = column[at]
            node = np.where(c == other, self.single[symbol[at]], self.go[node[:active], c])
            lane, found = np.arange(active), self.longest[node]
            while len(lane):
                if found.min() < 0:
                    raise ValueError(f"no path for {words[int(lane[found.argmin()])]!r}")
                left = j + 1 - self.depth[found]
                state = np.where(left > 0, self.state[label[begin[lane] + np.maximum(left - 1, 0)]], 0)
                ok = self.has_arc(state, self.place[found])
                label[begin[lane[ok]] + j] = found[ok]
                lane, found = lane[~ok], self.shorter[found[~ok]]
        # back along the paths
        first = np.zeros(len(symbol), bool)
        at, left = begin + n - 1, n.copy()
        lane = np.flatnonzero(left > 0)
        while len(lane):
            own = at[lane]
            first[own] = True
            size = self.depth[label[own]]
            at[lane] -= size
            left[lane] -= size
            lane = lane[left[lane] > 0]
        row = np.repeat(np.arange(len(words)), n)
        return self.token[label[first]], np.bincount(row[first], minlength=len(words))

    def decode(self, ids: list[int]) -> str:
        """The arc labels in order, one space between them: what a tokenizer without a decoder gives."""
        return " ".join(self.labels[i] for i in ids)


def load(path: str) -> Automaton:
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    return Automaton(model["vocab"], [tuple(m) for m in model["merges"]], model["end_of_word_suffix"])
