"""Encoding of long texts by way of their distinct segments.

A text is cut before each blank that a visible character follows; where runs of
blanks can be one piece, only before the first of a run. No pre-token crosses
such a cut, so a segment's ids do not depend on its neighbours, and a batch
encodes each distinct segment once.
"""

from __future__ import annotations

import numpy as np

from .bytesops import hash_spans, ragged

#: First bytes of the UTF-8 forms of blanks outside ASCII.
_UNSURE = np.zeros(256, bool)
_UNSURE[:33] = True
_UNSURE[[0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
#: Last bytes of what continues a run of blanks: the blank and the metaspace marker.
_RUN = np.zeros(256, bool)
_RUN[[32, 0x81]] = True


class SegmentEncoder:
    """Ids of texts from an encoder of segment lists.

    ``encode`` maps a list of strings to one id array each; ``lengths`` gives
    the bytes that an id stands for. Known segments stay in a bounded table.
    ``whole_runs``: runs of blanks are never cut. ``differs`` tells of texts and
    their ids which are wrong; ``odd`` then marks the last call's texts that have
    a wrong segment, whenever that was encoded.
    """

    def __init__(self, encode, lengths: np.ndarray, keep: int = 1 << 18, block: int = 1 << 15, whole_runs: bool = False, differs=None):
        self.whole_runs, self.differs = whole_runs, differs
        self.encode, self.lengths, self.keep, self.block = encode, lengths, keep, block
        self.hash = np.zeros(0, np.uint64)
        self.size = np.zeros(0, np.int64)
        self.at = np.zeros(0, np.int64)
        self.n = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.wrong = self.odd = np.zeros(0, bool)

    def texts(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts and, for each text, how many."""
        docs = len(off) - 1
        self.odd = np.zeros(docs, bool)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(docs, np.int64)
        buf = np.concatenate((data, np.zeros(8, np.uint8)))
        cut = np.zeros(len(data) + 1, bool)
        cut[:-1] = (data == 32) & ~_UNSURE[buf[1 : len(data) + 1]]
        if self.whole_runs:
            cut[1:-1] &= ~_RUN[data[:-1]]
        cut[off] = True
        edge = np.flatnonzero(cut)
        start, end = edge[:-1], edge[1:]
        first = np.zeros(len(data) + 1, bool)
        first[off] = True
        head = first[start] & ((data[start] != 32) | _UNSURE[buf[start + 1]])
        if self.whole_runs:
            # joined, a segment that ends in a blank would run into the next
            head |= _RUN[data[end - 1]]
        # a segment that opens a text has no cut before it, whatever its first byte
        h = hash_spans(buf, start, end) ^ head.astype(np.uint64)
        uniq, at, inverse = np.unique(h, return_index=True, return_inverse=True)
        ids_at, ids_n, wrong = self._known(buf, uniq, start[at], end[at], head[at])
        n = ids_n[inverse]
        out = self.ids[ragged(ids_at[inverse], n)]
        total = np.concatenate(([0], np.cumsum(n)))
        per = total[np.searchsorted(start, off[1:])] - total[np.searchsorted(start, off[:-1])]
        if wrong.any():
            bad = np.concatenate(([0], np.cumsum(wrong[inverse])))
            self.odd = bad[np.searchsorted(start, off[1:])] > bad[np.searchsorted(start, off[:-1])]
        return out, per

    def _known(self, buf, uniq, start, end, head):
        where = np.minimum(np.searchsorted(self.hash, uniq), max(len(self.hash) - 1, 0))
        have = (self.hash[where] == uniq) & (self.size[where] == end - start) if len(self.hash) else np.zeros(len(uniq), bool)
        new = np.flatnonzero(~have)
        if len(new):
            if len(self.hash) + len(new) > self.keep:
                self.hash, self.size, self.at, self.n, self.ids, self.wrong = self.hash[:0], self.size[:0], self.at[:0], self.n[:0], self.ids[:0], self.wrong[:0]
                new = np.arange(len(uniq))
            ids, n, wrong = self._encode(buf, start[new], end[new], head[new])
            at = len(self.ids) + np.concatenate(([0], np.cumsum(n)))[:-1]
            self.ids = np.concatenate((self.ids, ids))
            h = np.concatenate((self.hash, uniq[new]))
            order = np.argsort(h, kind="stable")
            self.hash = h[order]
            self.size = np.concatenate((self.size, (end - start)[new]))[order]
            self.at = np.concatenate((self.at, at))[order]
            self.n = np.concatenate((self.n, n))[order]
            self.wrong = np.concatenate((self.wrong, wrong))[order]
            where = np.searchsorted(self.hash, uniq)
        return self.at[where], self.n[where], self.wrong[where]

    def _encode(self, buf, start, end, head):
        """Segments that open with a blank go to the library joined, in blocks."""
        size = end - start
        n = np.zeros(len(start), np.int64)
        parts = np.empty(len(start), object)
        wrong = np.zeros(len(start), bool)
        alone = np.flatnonzero(head)
        if len(alone):
            texts = [bytes(buf[s:e]).decode() for s, e in zip(start[alone], end[alone])]
            found = self.encode(texts)
            if self.differs is not None:
                wrong[alone] = self.differs(texts, found)
            for i, ids in zip(alone, found):
                parts[i] = ids
                n[i] = len(ids)
        rest = np.flatnonzero(~head)
        if not len(rest):
            return (np.concatenate(list(parts)).astype(np.uint32) if len(parts) else np.zeros(0, np.uint32)), n, wrong
        total = np.cumsum(size[rest])
        groups = np.split(rest, np.flatnonzero(np.diff(total // self.block)) + 1)
        flat = np.zeros(0, np.uint32)
        blocks = []
        for i in range(0, len(groups), 64):
            some = groups[i : i + 64]
            texts = [bytes(buf[ragged(start[g], size[g])]).decode() for g in some]
            found = self.encode(texts)
            off = self.differs(texts, found) if self.differs is not None else np.zeros(len(some), bool)
            for g, ids, bad in zip(some, found, off):
                begin = np.cumsum(self.lengths[ids]) - self.lengths[ids]
                bound = np.concatenate(([0], np.cumsum(size[g])))
                first = np.searchsorted(begin, bound)
                if len(ids) and (begin[np.minimum(first[:-1], len(ids) - 1)] != bound[:-1]).any():
                    raise ValueError("an id crosses a segment's edge")
                n[g] = np.diff(first)
                blocks.append(ids)
                if bad:
                    # which of the block's segments; all, if none differs alone
                    own = self.differs([bytes(buf[s:e]).decode() for s, e in zip(start[g], end[g])], np.split(ids, first[1:-1]))
                    wrong[g] = own if np.any(own) else True
        flat = np.concatenate(blocks).astype(np.uint32)
        if not len(alone):
            return flat, n, wrong
        # put the segments of both kinds in their order
        out = np.zeros(int(n.sum()), np.uint32)
        at = np.cumsum(n) - n
        out[ragged(at[rest], n[rest])] = flat
        out[ragged(at[alone], n[alone])] = np.concatenate([parts[i] for i in alone]) if len(alone) else 0
        return out, n, wrong
