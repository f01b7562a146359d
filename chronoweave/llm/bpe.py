"""Byte-level BPE encoding by a dynamic program over prefixes, and decoding.

Texts are cut into pieces as the tokenizer's pre-tokenizer does. Within a piece, an Aho-Corasick automaton (the suffix
links of all vocabulary strings) yields every token that ends at each position. Exactly one of them can be the last token
of the merge result of that prefix: the one whose pair with the last token of the prefix before it is compatible, that
is, merging the two tokens' bytes gives the two tokens back. That token is stored for every prefix and the ids follow
by going back from the end. A vocabulary with other merges than its ids' order is refused.

Pieces repeat, so each worker keeps a bounded cache of encoded pieces; a miss costs only time. Nothing is shuffled.

Defined cases: null text: empty, no ids, the digests of the empty string. The tokenizer's added tokens are matched in
texts first, longest first. Repeated rows stay. Empty table: empty result.
"""

from __future__ import annotations

import hashlib
import json

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm.common import kept, lean, table

#: Encoded pieces that a worker keeps; older ones go all at once.
CACHE_PIECES = 600_000
#: Pieces longer than this many bytes aren't kept.
CACHE_BYTES = 64
SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


def byte_letters() -> dict[str, int]:
    """The printable stand-ins that vocabulary files use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        letters = byte_letters()
        model = spec["model"]
        self.bytes_of = {i: bytes(letters[c] for c in s) for s, i in model["vocab"].items()}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        before = -1
        for merge in model["merges"]:
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pair = model["vocab"][left], model["vocab"][right]
            made = model["vocab"][left + right]
            if made <= before or made <= max(pair):
                raise ValueError("ids must follow the order of the merges")
            self.halves[made], self.joined[pair], before = pair, made, made
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.added_of = {i: s.encode() for s, i in self.added.items()}
        self.cut = None
        if self.added:
            alternatives = "|".join(regex.escape(s) for s in sorted(self.added, key=len, reverse=True))
            self.cut = regex.compile(f"({alternatives})")
        self.split = regex.compile(SPLIT).findall
        self.compatible: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, str] = {}
        self.odd: dict[str, bytes] = {}
        self.automaton = ahocorasick.Automaton()
        self.whole: dict[bytes, int] = {}
        stays: dict[int, bool] = {}
        for i, b in sorted(self.bytes_of.items()):
            # tokens that their own bytes don't give can be no result of merging
            if stays.setdefault(i, len(b) == 1 or i in self.halves and self._whole_stays(i, stays)):
                self.whole[b] = i
                self.automaton.add_word(b.decode("latin-1"), (len(b), i))
        self.automaton.make_automaton()

    def pair_stays(self, left: int, right: int) -> bool:
        """Whether merging the bytes of two tokens leaves just these two tokens.

        Undo the later of the merges that made the facing ends, step by step. A merge across the border is possible at
        that point in time if its two ends are tokens by then and it comes before the merges that were undone; if there
        is one at any step, the pair does not stay.
        """
        key = (left, right)
        known = self.compatible.get(key)
        if known is not None:
            return known
        limit, stays = 1 << 60, None
        while stays is None:
            made = self.joined.get((left, right))
            if made is not None and made < limit:
                stays = False
            elif left > right and left in self.halves:
                limit, left = left, self.halves[left][1]
            elif right in self.halves:
                # a merge across the border of equal age takes place first, as it starts further left
                limit, right = right + 1, self.halves[right][0]
            elif left in self.halves:
                limit, left = left, self.halves[left][1]
            else:
                stays = True
        if len(self.compatible) > 4_000_000:
            self.compatible.clear()
        self.compatible[key] = stays
        return stays

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.whole.get(piece)
        if whole is not None:
            return [whole]
        last = [0] * (len(piece) + 1)
        size = last[:]
        stays, known = self.pair_stays, self.compatible.get
        for end, (n, token) in self.automaton.iter(piece.decode("latin-1")):
            end += 1
            if size[end]:
                continue
            start = end - n
            if start:
                if not size[start]:
                    continue
                pair = (last[start], token)
                ok = known(pair)
                if ok is None:
                    ok = stays(*pair)
                if not ok:
                    continue
            last[end], size[end] = token, n
        ids, at = [], len(piece)
        while at:
            ids.append(last[at])
            at -= size[at]
        return ids[::-1]

    def _whole_stays(self, token: int, stays: dict[int, bool]) -> bool:
        """Whether merging a token's own bytes gives the token: its halves are given by theirs and nothing else merges."""
        a, b = self.halves[token]
        return stays[a] and stays[b] and self._until(a, b, token)

    def _until(self, left: int, right: int, last: int) -> bool:
        """Like pair_stays, but merges from ``last`` on don't count."""
        limit = last
        while True:
            made = self.joined.get((left, right))
            if made is not None and made < limit:
                return False
            if left > right and left in self.halves:
                limit, left = min(limit, left), self.halves[left][1]
            elif right in self.halves:
                limit, right = min(limit, right + 1), self.halves[right][0]
            elif left in self.halves:
                limit, left = min(limit, left), self.halves[left][1]
            else:
                return True

    def lookup(self, piece: str) -> str:
        """Decimal ids joined by commas; they are decoded once, and pieces that decode to other bytes are noted."""
        raw = piece.encode()
        ids = self.encode_piece(raw)
        back = b"".join([self.bytes_of[i] for i in ids])
        if back != raw:
            self.odd[piece] = back
        found = ",".join(map(str, ids))
        if len(piece) <= CACHE_BYTES:
            if len(self.pieces) >= CACHE_PIECES:
                self.pieces.clear()
            self.pieces[piece] = found
        return found

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, ids joined by commas, decoded text of one text, all by piece."""
        known, lookup = self.pieces.get, self.lookup
        ids: list[str] = []
        back: list[bytes] = []
        for part in self.cut.split(text) if self.cut else [text]:
            if self.cut and part in self.added:
                ids.append(str(self.added[part]))
                back.append(self.added_of[self.added[part]])
            elif part:
                pieces = self.split(part)
                ids += [known(p) or lookup(p) for p in pieces]
                odd = self.odd
                back.append(b"".join([odd.get(p) or p.encode() for p in pieces]) if odd else part.encode())
        joined = ",".join(ids)
        return joined.count(",") + 1 if joined else 0, joined, b"".join(back).decode("utf-8", "replace")

    def encode(self, text: str) -> list[int]:
        ids = self.digest(text)[1]
        return [int(i) for i in ids.split(",")] if ids else []

    def decode(self, ids: list[int]) -> str:
        own = self.bytes_of
        return b"".join([own[i] if i in own else self.added_of[i] for i in ids]).decode("utf-8", "replace")


def codec(path: str) -> Codec:
    """One codec a worker process and file, until another operator runs there."""
    return kept("codec", path, lambda: Codec(path))


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids (array of int) and decoded text of every row."""

    def run(batches):
        own = codec(tokenizer)
        for batch in batches:
            for small in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
                texts = [own.digest(t or "") for t in small.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        small.column(0),
                        pa.array([[int(i) for i in t[1].split(",")] if t[1] else [] for t in texts], pa.list_(pa.int32())),
                        pa.array([t[2] for t in texts], pa.string()),
                    ],
                    names=["doc_id", "ids", "decoded"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        lean(run, "codec"), "doc_id long, ids array<int>, decoded string"
    )


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; ids never leave the worker."""

    def run(batches):
        own = codec(tokenizer)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            out = []
            for scalar in pc.fill_null(batch.column(1), ""):
                n, ids, decoded = own.digest(scalar.as_py())
                out.append((n, sha(ids), sha(decoded)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([x[0] for x in out], pa.int64()),
                    pa.array([x[1] for x in out], pa.string()),
                    pa.array([x[2] for x in out], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run, "codec"), schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), default_tokenizer())
