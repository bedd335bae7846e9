"""Token ids of whole texts by a tokenizers vocabulary file, word by word.

The pre-tokenizer of such a vocabulary never lets a token cross white space, so
the ids of a text are the ids of its white-space-separated chunks in a row.
Words follow Zipf's law: a bounded cache of chunks answers most of them, and
the library encodes the rest of a batch in one call, chunks kept apart by the
vocabulary's own start-of-text token.
"""

from __future__ import annotations

import os
from pathlib import Path

import numpy as np

WORD_BPE = "word_bpe_49k.json"


def vocabulary(name: str = WORD_BPE) -> str:
    """Path of a public vocabulary file; any other path may be given to the operators."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


class ChunkEncoder:
    """``ids(texts)`` gives for each text its ids as little-endian unsigned 32-bit bytes."""

    SEPARATOR = "<|startoftext|>"

    def __init__(self, path: str, old: int = 400_000, young: int = 300_000) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.separator = self.tokenizer.token_to_id(self.SEPARATOR)
        self.bare = Tokenizer(self.tokenizer.model)  # the merges alone: a-z need no normaliser and are one pre-token
        # ids that end a pre-token, so that words encoded in one call can be told apart
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        #: the chunks met first stay; later ones are forgotten whenever ``young`` of them have gathered
        self.old, self.young = old, young
        self.known: dict[bytes, bytes] = {}
        self.recent: list[bytes] = []
        # These marks end a word as a token of their own.
        self.marks = {bytes([c]): self._alone(chr(c)) for c in b".,"}

    def _alone(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _joined(self, words: list[str], by: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([by.join(words)], add_special_tokens=False)[0].ids, "<u4")

    def _cut(self, out: dict[bytes, bytes], words: list[bytes], ids: np.ndarray) -> bool:
        """Give each word its ids, if every word has one end among them."""
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words):
            return False
        raw, ends = ids.tobytes(), (4 * cuts).tolist()
        out.update((w, raw[a:b]) for w, a, b in zip(words, [0, *ends[:-1]], ends, strict=True))
        return True

    def _encode(self, plain: list[bytes], stems: list[bytes], others: list[bytes]) -> dict[bytes, bytes]:
        """plain: of a-z only; stems: of letters only, so one pre-token each."""
        out: dict[bytes, bytes] = {}
        for start in range(0, len(plain), 8192):
            part = plain[start : start + 8192]
            found = self.bare.encode_batch_fast([[w.decode() for w in part]], is_pretokenized=True, add_special_tokens=False)[0].ids
            if not self._cut(out, part, np.array(found, "<u4")):
                stems = stems + part
        for start in range(0, len(stems), 8192):
            part = stems[start : start + 8192]
            if self.separator is None or not self._cut(out, part, self._joined([w.decode() for w in part], " ")):
                others = others + part
        for start in range(0, len(others), 8192):
            part = others[start : start + 8192]
            if self.separator is None or any(b"<|" in w for w in part):
                out.update((w, self._alone(w.decode())) for w in part)
                continue
            ids = self._joined([w.decode() for w in part], self.SEPARATOR)
            cuts = np.flatnonzero(ids == self.separator)
            raw, starts, ends = ids.tobytes(), [0, *(4 * cuts + 4).tolist()], [*(4 * cuts).tolist(), 4 * len(ids)]
            out.update((w, raw[a:b]) for w, a, b in zip(part, starts, ends, strict=True))
        return out

    def _learn(self, missing: set[bytes]) -> None:
        known, marks = self.known, self.marks
        # a word of plain letters and the mark behind it are separate tokens
        marked: dict[bytes, bytes] = {}
        plain, stems, others = set(), set(), []
        for w in missing:
            if w.isalpha():
                (plain if w.islower() else stems).add(w)
                continue
            stem = w[:-1] if w[-1:] in marks else w
            if stem.isalpha():
                kind = plain if stem.islower() else stems
            elif (text := stem.decode().lower()).isalpha() and max(text) < "ɐ":
                kind = stems
            else:
                others.append(w)
                continue
            if stem is not w:
                marked[w] = stem
            if stem not in known:
                kind.add(stem)
        new = self._encode(list(plain), list(stems), others)
        known.update(new)
        new.update((w, known[stem] + marks[w[-1:]]) for w, stem in marked.items())
        known.update(new)
        if len(known) > self.old:
            self.recent.extend(new)

    def _forget(self) -> None:
        if len(self.recent) > self.young:
            for w in self.recent:
                self.known.pop(w, None)
            self.recent.clear()

    def ids(self, texts: list[bytes]) -> list[bytes]:
        # Lower-casing A-Z first changes nothing that this vocabulary's own
        # normaliser would not, unless a combining mark (their UTF-8 begins with
        # CC or CD) composes with the letter or a special token is spelt out.
        lists = [(t if b"\xcc" in t or b"\xcd" in t or b"<|" in t else t.lower()).split() for t in texts]
        # each word is looked up once; only those not found are gathered and looked up again
        found = [list(map(self.known.get, words)) for words in lists]
        missing = {w for words, ids in zip(lists, found, strict=True) for w, i in zip(words, ids, strict=True) if i is None}
        if missing:
            self._learn(missing)
            known = self.known
            found = [[known[w] if i is None else i for w, i in zip(words, ids, strict=True)] for words, ids in zip(lists, found, strict=True)]
        out = [b"".join(ids) for ids in found]
        self._forget()
        return out


ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each Python worker and vocabulary, so that its cache outlives a task."""
    if path not in ENCODERS:
        if not Path(path).is_file():
            raise FileNotFoundError(path)
        ENCODERS[path] = ChunkEncoder(path)
    return ENCODERS[path]
