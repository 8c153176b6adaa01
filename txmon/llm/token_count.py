"""Token counts of a word-end BPE vocabulary with a whole-token shortcut.

Offline, once per vocabulary, every vocabulary string that closes a word is encoded alone; those that
come out as one token go into the shortcut set (a fixed table, at most the vocabulary's size). Texts are
normalised and cut into pre-tokens; a pre-token in the set counts one, any other is merged by the
library and remembered in a bounded cache. Special strings are matched in the raw text first,
as the library does by default.

Normal forms and character classes of this side are used only where they are proven, offline as well, to be the library's: code points
that both sides normalise and cut alike, and that never combine with a neighbour. A text with any other code point (combining marks, Hangul
jamo, characters of other Unicode versions) is handed to the library whole.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txmon.llm.common import ROW, pack, slices, text_of, unpack

#: Merged pre-tokens remembered by one Python worker.
CACHE_WORDS = 500_000

# Contractions and classes of the vocabulary's own split pattern, for lower-cased text.
_SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SHORT = r"'s|'t|'re|'ve|'m|'ll|'d"
#: The same classes spelled out below U+0180, where the standard library's matcher is much faster.
_LATIN = (r"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t\n\x0b\x0c\r \x85\xa0")
_LATIN_PATTERN = rf"[{_LATIN[0]}]+|{_SHORT}|[{_LATIN[1]}]|[^{''.join(_LATIN)}]+"
_UNICODE_PATTERN = rf"{_SHORT}|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+"


def _byte_letters() -> dict[int, str]:
    """Printable stand-in of every byte in byte-level vocabularies: Latin-1 graphics stay, the rest follow from 256."""
    stay = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {}, 0
    for b in range(256):
        if b in stay:
            out[b] = chr(b)
        else:
            out[b], extra = chr(256 + extra), extra + 1
    return out


#: Code points proven at once when they agree; a block that does not agree as a whole is halved.
_BLOCK = 512
#: Beyond this every code point is the library's.
_LAST_PROVEN = 0xFFFF


def _never_combines(c: str) -> bool:
    """Whether normal form C leaves the character and its neighbours alone: no mark, no second half of a composed character."""
    return (unicodedata.category(c) not in ("Cn", "Cs", "Mn", "Mc", "Me") and unicodedata.is_normalized("NFC", c)
            and not 0x1100 <= ord(c) <= 0x11FF and not 0xD7B0 <= ord(c) <= 0xD7FF)


class TokenCounter:
    def __init__(self, path: str, single: frozenset[str] | None = None, unproven: str | None = None):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        specials = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        import regex

        self.latin = re.compile(_LATIN_PATTERN)
        self.beyond = re.compile("[^\x00-\u017f]")
        self.unicode = regex.compile(_UNICODE_PATTERN)
        self.unproven = self.prove_characters() if unproven is None else unproven
        self.strange = re.compile(f"[{self.unproven}]")
        self.single = self.prove() if single is None else single
        self.counts = dict.fromkeys(self.single, 1)

    def agrees(self, chars: list[str]) -> bool:
        """Whether the library normalises and cuts the characters, each between letters, digits, signs and blanks, as this side does."""
        probe = "".join(f"a{c}a1{c}1!{c}!{c}{c} {c} A{c.swapcase()}" for c in chars)
        normal = self.lib.normalizer.normalize_str(probe) if self.lib.normalizer is not None else probe
        # what the library cuts is its normal form: positions are enough, its stand-ins for bytes are not compared
        cuts = [normal[a:b] for _, (a, b) in self.lib.pre_tokenizer.pre_tokenize_str(normal)]
        own = unicodedata.normalize("NFC", probe).replace("Σ", "σ").lower()
        return self.unicode.findall(own) == cuts  # of blanks only the place matters, the library joins runs of them

    def prove_characters(self) -> str:
        """Character class (ranges) of the code points that are left to the library."""
        fine: set[int] = set()
        tests = [chr(c) for c in range(_LAST_PROVEN + 1) if not 0xD800 <= c <= 0xDFFF and _never_combines(chr(c))]
        stack = [tests[i:i + _BLOCK] for i in range(0, len(tests), _BLOCK)]
        while stack:
            chars = stack.pop()
            if self.agrees(chars):
                fine.update(map(ord, chars))
            elif len(chars) > 1:
                stack += [chars[:len(chars) // 2], chars[len(chars) // 2:]]
        ranges, start = [], None
        for c in [*range(_LAST_PROVEN + 1), None]:
            strange = c is not None and c not in fine
            if strange and start is None:
                start = c
            if not strange and start is not None:
                ranges.append((start, (c if c is not None else _LAST_PROVEN + 1) - 1))
                start = None
        return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in [*ranges, (_LAST_PROVEN + 1, 0x10FFFF)])

    def prove(self, word_end: str = "</w>") -> frozenset[str]:
        """Vocabulary strings that, alone, are one pre-token and one token."""
        back = {c: b for b, c in _byte_letters().items()}
        words = []
        for piece in self.lib.get_vocab(with_added_tokens=False):
            if not piece.endswith(word_end):
                continue
            try:
                word = bytes(back[c] for c in piece[: -len(word_end)]).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            if word and self.pre_tokens(word) == [word]:
                words.append(word)
        found = self.lib.encode_batch(words, add_special_tokens=False)
        return frozenset(w for w, e in zip(words, found) if len(e.ids) == 1)

    def pre_tokens(self, text: str) -> list[str]:
        if not text.isascii():
            # capital sigma first: str.lower() would look at its neighbours, the library does not
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
            return (self.unicode if self.beyond.search(text) else self.latin).findall(text)
        return self.latin.findall(text.lower())

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of every text; what no shortcut covers is merged for all texts at once."""
        found, extra = [], []
        left = [k for k, text in enumerate(texts) if not text.isascii() and self.strange.search(text)]
        whole = {k: len(e.ids) for k, e in zip(left, self.lib.encode_batch_fast([texts[k] for k in left], add_special_tokens=False))}
        for k, text in enumerate(texts):
            if k in whole:
                extra.append(whole[k])
                found.append([])
                continue
            parts = self.special.split(text) if self.special is not None else [text]
            extra.append(len(parts) - 1)  # special strings, a token each
            found.append(self.pre_tokens(parts[0]) if len(parts) == 1 else [w for p in parts for w in self.pre_tokens(p)])
        rest = set().union(*found)
        if len(self.counts) + len(rest) > len(self.single) + CACHE_WORDS:
            self.counts = dict.fromkeys(self.single, 1)
        new = [w for w in rest if w not in self.counts]
        self.counts.update(zip(new, map(len, self.lib.encode_batch_fast(new, add_special_tokens=False))))
        return [n + sum(map(self.counts.__getitem__, words)) for n, words in zip(extra, found)]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, text_col: str = "text",
                 carry: list[str] | None = None) -> DataFrame:
    """Rows of ``docs`` (``carry`` columns, default all) plus n_bytes, n_tokens, over_limit.

    ``vocabulary`` is the path of a ``tokenizers`` JSON file of the word-end kind that every worker can
    read. Null and empty texts have no tokens. Rows are independent: repeated rows, any text length and empty
    tables need nothing special. Input columns named like the added ones are replaced.
    """
    carry = docs.columns if carry is None else carry
    shape = docs.select(*[f"`{c}`" for c in carry]).schema
    proven = TokenCounter(vocabulary)  # the vocabulary's single tokens and a few hundred ranges of code points
    shared = docs.sparkSession.sparkContext.broadcast((proven.single, proven.unproven))
    base = pack(docs, carry, _text=text_of(text_col))
    schema = base.drop("_text").schema.add("_bytes", "long").add("_tokens", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core is all there is
        counter = TokenCounter(vocabulary, *shared.value)
        for batch in slices(batches, "_text", 4 << 20):
            texts = batch.column("_text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(ROW), pa.array([len(t.encode()) for t in texts], pa.int64()),
                 pa.array(counter.count(texts), pa.int64())], [ROW, "_bytes", "_tokens"])

    return unpack(base.mapInArrow(run, schema), shape, {
        "n_bytes": F.col("_bytes"), "n_tokens": F.col("_tokens"), "over_limit": F.col("_tokens") > limit})
