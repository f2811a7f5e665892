"""Edit-aware token counts.

Each document keeps a segment tree over its pre-tokens: a leaf stands for some
consecutive pre-tokens and holds their characters and tokens, an inner node the
sums below it. An edit finds its leaf by descending the character sums, starts a
few characters before the edit (what the pre-token pattern may look ahead),
splits and encodes from that leaf's begin until a boundary meets an old leaf's
end behind the edit, and updates the sums above the leaves in between. The rest
of the text is neither split nor encoded again.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacewise.llm.common import text_session

#: Pre-tokens per leaf of a new tree; a leaf that edits fill to more than twice that makes the tree anew.
LEAF = 64
#: Characters behind a pre-token that the pattern may look at ('re, 've and 'll; white space before a word).
CONTEXT = 3
REMEMBERED = 200_000
TREE = "chars array<bigint>, tokens array<bigint>"
EDITS = "array<struct<at:bigint,removed:bigint,inserted:string>>"


class Counter:
    """Tokens of pre-tokens under a byte-level BPE of tiktoken, remembered by the Python worker."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import regex
        import tiktoken

        with open(path, "rb") as f:  # a vocabulary file of the installed package, on every machine
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.encoding = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, int] = {}

    def count(self, pre_token: str) -> int:
        found = self.known.get(pre_token)
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = self.known[pre_token] = len(self.encoding.encode_ordinary(pre_token))
        return found

    def total(self, pre_tokens: list[str]) -> int:
        return sum(map(self.count, pre_tokens))


@functools.cache
def counter(path: str) -> Counter:
    return Counter(path)


@dataclass
class TokenTree:
    """Sums in heap order: node 1 is the root, node k has children 2k and 2k + 1, leaves fill the second half."""

    chars: list[int]
    tokens: list[int]

    @staticmethod
    def of(leaves: list[tuple[int, int]]) -> TokenTree:
        size = 1
        while size < len(leaves):
            size *= 2
        sums = []
        for k in (0, 1):
            nodes = [0] * size + [x[k] for x in leaves] + [0] * (size - len(leaves))
            for i in range(size - 1, 0, -1):
                nodes[i] = nodes[2 * i] + nodes[2 * i + 1]
            sums.append(nodes)
        return TokenTree(*sums)

    @staticmethod
    def build(text: str, by: Counter) -> TokenTree:
        return TokenTree.of(leaves_of(by.pattern.findall(text), by, LEAF))

    @property
    def size(self) -> int:
        return len(self.chars) // 2

    @property
    def total(self) -> int:
        return self.tokens[1]

    def leaf_at(self, at: int) -> tuple[int, int]:
        """(leaf, its first character) that holds character ``at``, or the last leaf with characters."""
        node, before = 1, 0
        at = max(0, min(at, self.chars[1] - 1))
        while node < self.size:
            node *= 2
            if at - before >= self.chars[node]:
                before += self.chars[node]
                node += 1
        return node - self.size, before

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.size
        more_chars, more_tokens = chars - self.chars[node], tokens - self.tokens[node]
        while node:
            self.chars[node] += more_chars
            self.tokens[node] += more_tokens
            node //= 2

    def edit(self, text: str, at: int, removed: int, inserted: str, by: Counter) -> tuple[TokenTree, str, int]:
        """The tree and text after replacing ``removed`` characters at ``at``, and the characters encoded again."""
        at = max(0, min(at, len(text)))
        removed = max(0, min(removed, len(text) - at))
        new, shift = text[:at] + inserted + text[at + removed:], len(inserted) - removed
        leaf, begin = self.leaf_at(at - CONTEXT)
        last, end = leaf, begin + self.chars[self.size + leaf]  # the old leaves from `leaf` to `last` end at `end`

        def behind() -> bool:
            return end >= at + removed

        pre_tokens, reached = [], begin
        while not (behind() and reached == end + shift):
            if reached > end + shift or not behind():
                if last + 1 < self.size:
                    last += 1
                    end += self.chars[self.size + last]
                    continue
                if reached == len(new):
                    break
            m = by.pattern.match(new, reached)
            pre_tokens.append(m[0])
            reached = m.end()
        per = -(-len(pre_tokens) // (last - leaf + 1)) if pre_tokens else 0
        if per <= 2 * LEAF:
            for k in range(last - leaf + 1):
                own = pre_tokens[k * per:(k + 1) * per]
                self.put(leaf + k, sum(map(len, own)), by.total(own))
            return self, new, reached - begin
        own = list(zip(self.chars[self.size:], self.tokens[self.size:], strict=True))
        kept = [x for x in own[:leaf] if x[0]], [x for x in own[last + 1:] if x[0]]
        return TokenTree.of([*kept[0], *leaves_of(pre_tokens, by, LEAF), *kept[1]]), new, reached - begin


def leaves_of(pre_tokens: list[str], by: Counter, size: int) -> list[tuple[int, int]]:
    groups = [pre_tokens[k:k + size] for k in range(0, len(pre_tokens), size)]
    return [(sum(map(len, g)), by.total(g)) for g in groups]


def build_trees(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """``docs`` with the state to keep: columns chars and tokens, the two sum trees of each text.

    ``docs`` has a text; its other columns stay as they are, but for columns chars
    and tokens of its own, which are given back as given_chars and given_tokens. A
    null text is empty; an empty text has a tree of one empty leaf.
    """

    def trees(texts: pa.Array) -> pa.Array:
        by = counter(tokenizer_path)
        built = [TokenTree.build(t or "", by) for t in texts.to_pylist()]
        lists = pa.list_(pa.int64())
        return pa.StructArray.from_arrays([pa.array([t.chars for t in built], lists), pa.array([t.tokens for t in built], lists)], names=["chars", "tokens"])

    others = [F.col(f"`{c}`").alias(f"given_{c}" if c in ("chars", "tokens") else c) for c in docs.columns]
    names = [F.col(f"`given_{c}`" if c in ("chars", "tokens") else f"`{c}`") for c in docs.columns]
    udf = F.arrow_udf(trees, f"struct<{TREE.replace(' array', ':array')}>")
    return text_session(docs).select(*others, udf("text").alias("_tree")).select(*names, "_tree.chars", "_tree.tokens")


def state_batch(doc_ids: pa.Array, texts: list[str], trees: list[TokenTree], **more: list[int]) -> pa.RecordBatch:
    lists = pa.list_(pa.int64())
    columns = {"doc_id": doc_ids, "text": pa.array(texts, pa.string()), "chars": pa.array([t.chars for t in trees], lists),
               "tokens": pa.array([t.tokens for t in trees], lists)} | {k: pa.array(v, pa.int64()) for k, v in more.items()}
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def attach_edits(state: DataFrame, log: DataFrame) -> DataFrame:
    """``state`` with the edits of an edit log (doc_id, seq, at, removed, inserted) in an array, in order of seq.

    A document's edits apply one after the other, so they go to its row
    together; positions refer to the text as the earlier edits left it. Columns of
    ``state`` stay as they are, but for one named edits, which this replaces.
    """
    one = F.struct("seq", F.struct(F.col("at").cast("long").alias("at"), F.col("removed").cast("long").alias("removed"), "inserted").alias("e"))
    per = log.groupBy(F.col("doc_id").alias("_id")).agg(F.array_sort(F.collect_list(one)).alias("_log"))
    none = F.array().cast(EDITS)
    return (state.join(per, F.col("doc_id") == F.col("_id"), "left")
            .select(*[state[f"`{c}`"] for c in state.columns if c != "edits"], F.coalesce(F.col("_log.e"), none).alias("edits")))


def apply_edits(rows: DataFrame, tokenizer_path: str) -> DataFrame:
    """The state after the edits of each row (doc_id, text, chars, tokens, edits), and what that took.

    Returns doc_id, text, chars, tokens, n_before, n_tokens, n_edits,
    recounted_chars. Edits outside the text are clamped to it; a null position
    or number counts as 0, a null insertion as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = counter(tokenizer_path)
        for batch in batches:
            texts, trees, before, edits, recounted = [], [], [], [], []
            for text, chars, tokens, changes in zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True):
                text, tree, again = text or "", TokenTree(chars, tokens), 0
                before.append(tree.total)
                for e in changes or ():
                    tree, text, n = tree.edit(text, e["at"] or 0, e["removed"] or 0, e["inserted"] or "", by)
                    again += n
                texts.append(text)
                trees.append(tree)
                edits.append(len(changes or ()))
                recounted.append(again)
            yield state_batch(batch.column(0), texts, trees, n_before=before, n_tokens=[t.total for t in trees], n_edits=edits, recounted_chars=recounted)

    schema = f"doc_id bigint, text string, {TREE}, n_before bigint, n_tokens bigint, n_edits bigint, recounted_chars bigint"
    return rows.select(F.col("doc_id").cast("long"), "text", "chars", "tokens", "edits").mapInArrow(run, schema)
