"""Encoding into SentencePiece pieces with the N best segmentations, and decoding."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from tidemark.llm.common import query, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 4
#: Words of a task whose segmentations are remembered from batch to batch.
REMEMBERED = 400_000

BLANK = "▁"  # stands for a blank in pieces
LITERAL = "\ud800"  # stands for a U+2581 of the text, which no piece spells
#: An unknown character costs this more than the lowest score of a piece.
UNKNOWN_PENALTY = 10.0


def load(model: str = MODEL) -> dict:
    """What encoding and decoding need of a model file, as plain values; a vocabulary has a fixed size."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    ids = range(sp.get_piece_size())
    usual = [i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
    spelled = {sp.id_to_piece(i): (i, sp.get_score(i)) for i in usual}
    table = {p[:k]: spelled.get(p[:k]) for p in spelled for k in range(1, len(p) + 1)}  # other beginnings: None
    return {
        "pieces": table,
        "trie": trie_of(table),
        "alone": {p for p in spelled if len(p) == 1},
        "unknown": min(s for _, s in spelled.values()) - UNKNOWN_PENALTY,
        "bytes": [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)],
        "text": [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i)
                 else sp.id_to_piece(i).replace(BLANK, " ").encode() for i in ids],
        # if no piece goes on over a blank or line feed, segmentations are put together from those of words;
        # nor do pieces but these go on from a letter or digit to another character, so words can end there
        "by_word": not any(BLANK in p.lstrip(BLANK) or "\n" in p for p in spelled),
        "over_ends": sorted({a + b for p in spelled for a, b in zip(p, p[1:]) if END.fullmatch(a + b)}),
    }


def trie_of(pieces: dict[str, tuple[int, float] | None]) -> dict[str, np.ndarray]:
    """Beginnings of pieces as numbers: a step is looked up by (number, character) among the sorted steps."""
    nodes = {p: k for k, p in enumerate(sorted(pieces), 1)}
    steps = sorted((nodes.get(p[:-1], 0) << 21 | ord(p[-1]), k) for p, k in nodes.items())
    known = [pieces[p] or (-1, 0.0) for p in nodes]
    return {"steps": np.array([s for s, _ in steps]), "to": np.array([k for _, k in steps]),
            "ids": np.array([-1, *[i for i, _ in known]]), "scores": np.array([0.0, *[s for _, s in known]])}


END = re.compile(r"\w\W")
LONG_WORDS = re.compile(f"\n|{BLANK}*[^{BLANK}\n]+|{BLANK}+")
WORDS = re.compile(f"\n|{BLANK}*[^{BLANK}\n\\w]*\\w+|{BLANK}*[^{BLANK}\n\\w]+|{BLANK}+")


def normalised(text: str) -> str:
    """As the model was made: blanks escaped, one more in front; nothing else changes."""
    return BLANK + text.replace(BLANK, LITERAL).replace(" ", BLANK) if text else ""


def words_of(text: str, vocabulary: dict) -> list[str]:
    escaped = normalised(text)
    if not vocabulary["by_word"]:
        return [escaped] if escaped else []
    return (LONG_WORDS if any(pair in escaped for pair in vocabulary["over_ends"]) else WORDS).findall(escaped)


def pieces_from(word: str, start: int, vocabulary: dict) -> list[tuple[int, int, float]]:
    """The pieces (end, id, score) that begin at a place; -1 - start is the id of an unknown character."""
    table = vocabulary["pieces"]
    out = []
    for end in range(start + 1, len(word) + 1):
        known = table.get(word[start:end], False)
        if known:
            out.append((end, *known))
        elif known is False:
            break
    if not out or out[0][0] > start + 1:
        out.append((start + 1, -1 - start, vocabulary["unknown"]))
    return out


def ids_of(path: list[int], word: str, vocabulary: dict) -> list[int]:
    """Unknown characters become their bytes."""
    if min(path, default=0) >= 0:
        return path
    spell = lambda p: word[-1 - p].replace(LITERAL, BLANK).encode("utf-8", "surrogatepass")
    return [i for p in path for i in ([p] if p >= 0 else [vocabulary["bytes"][b] for b in spell(p)])]


def best_two(word: str, vocabulary: dict) -> tuple[list[int], float, float]:
    """Viterbi: ids and score of the best segmentation, and the score of the second best (-inf if there is none)."""
    size, get = len(word), vocabulary["pieces"].get
    first, second = [0.0] + [-np.inf] * size, [-np.inf] * (size + 1)
    back: list = [None] * (size + 1)
    for start in range(size):  # pieces_from() written out: this is the inner loop over all new words
        one, two, end = first[start], second[start], start + 1
        known = get(word[start]) or (-1 - start, vocabulary["unknown"])
        while known is not False:
            if known:
                piece, score = known
                if one + score > first[end]:
                    second[end] = first[end] if first[end] > two + score else two + score
                    first[end], back[end] = one + score, (start, piece)
                elif one + score > second[end]:
                    second[end] = one + score
            end += 1
            known = end <= size and get(word[start:end], False)
    path, at = [], size
    while at:
        at, piece = back[at]
        path.append(piece)
    return ids_of(path[::-1], word, vocabulary), first[size], second[size]


def n_best(word: str, n: int, vocabulary: dict) -> list[tuple[float, list[int]]]:
    """The n best segmentations (score, ids), best first; a score is the sum of the pieces' scores.

    Forward: Viterbi scores of the best segmentation up to each position. Backward: A* from the end, where those
    scores are the exact rest of the way, so complete paths leave the queue in order of score. Equal scores: the
    path nearer the start goes on first, then the one found first. An unknown character becomes its bytes.
    """
    size = len(word)
    ahead: list[list[tuple]] = [[] for _ in range(size + 1)]  # pieces by their end: start, id, score
    best = [0.0] + [-np.inf] * size
    for start in range(size):
        for end, piece, score in pieces_from(word, start, vocabulary):
            ahead[end].append((start, piece, score))
            best[end] = max(best[end], best[start] + score)
    queue: list[tuple] = [(-best[size], size, 0, 0.0, None)]
    found: list[tuple[float, list[int]]] = []
    pushed = 0
    while queue and len(found) < n:
        _, at, _, cost, path = heappop(queue)
        if at == 0:
            ids = []
            while path is not None:
                piece, path = path
                ids.append(piece)
            found.append((cost, ids_of(ids, word, vocabulary)))
            continue
        for start, piece, score in ahead[at]:
            pushed += 1
            heappush(queue, (-(best[start] + cost + score), start, pushed, cost + score, (piece, path)))
    return found


#: Words up to this length are segmented together.
SHORT = 64


def best_two_of_all(words: list[str], trie: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """best_two() of many words of known characters at once: ids, their ends by word, scores of the best and second best.

    Pieces are found step by step for all places together; Viterbi goes by the place in the word, for all words together.
    """
    sizes = np.array([len(w) for w in words])
    chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    word = np.repeat(np.arange(len(words)), sizes)
    begin = np.cumsum(sizes) - sizes
    place = np.arange(len(chars)) - begin[word]
    start, node, found = np.arange(len(chars)), np.zeros(len(chars), np.int64), []
    for length in range(1, SHORT + 1):
        inside = place[start] + length <= sizes[word[start]]
        start, node = start[inside], node[inside]
        step = node << 21 | chars[start + length - 1]
        at = np.minimum(np.searchsorted(trie["steps"], step), len(trie["steps"]) - 1)
        there = trie["steps"][at] == step
        start, node = start[there], trie["to"][at[there]]
        if not len(start):
            break
        spelled = trie["ids"][node] >= 0
        found.append((start[spelled], np.full(spelled.sum(), length), node[spelled]))
    start, length, node = (np.concatenate(f) for f in zip(*found))
    # states: places of all words, one more each; pieces in the order of the place they end at
    source = start + word[start]
    target, last = source + length, place[start] + length
    order = np.lexsort((start, target, last))
    source, target, last, node, score = source[order], target[order], last[order], node[order], trie["scores"][node[order]]
    states = len(chars) + len(words)
    first, second, back = np.full(states, -np.inf), np.full(states, -np.inf), np.zeros(states, np.int64)
    first[begin + np.arange(len(words))] = 0.0
    cuts = np.searchsorted(last, np.arange(1, sizes.max() + 2))
    for low, high in zip(cuts, cuts[1:]):
        goal = target[low:high]
        heads = np.flatnonzero(np.concatenate([[True], goal[1:] != goal[:-1]]))
        group = np.repeat(np.arange(len(heads)), np.diff([*heads, high - low]))
        reach = first[source[low:high]] + score[low:high]
        best = np.maximum.reduceat(reach, heads)
        ties = np.flatnonzero(reach == best[group])
        chosen = ties[np.concatenate([[True], group[ties][1:] != group[ties][:-1]])]
        reach[chosen] = -np.inf
        other = np.maximum.reduceat(np.maximum(reach, second[source[low:high]] + score[low:high]), heads)
        first[goal[heads]], second[goal[heads]], back[goal[heads]] = best, other, low + chosen
    end = begin + np.arange(len(words)) + sizes
    at, left, steps = end.copy(), np.arange(len(words)), []
    while len(left):
        piece = back[at[left]]
        steps.append((left, trie["ids"][node[piece]]))
        at[left] = source[piece]
        left = left[at[left] > begin[left] + left]
    counts = np.bincount(np.concatenate([w for w, _ in steps]), minlength=len(words))
    ends = np.cumsum(counts)
    ids = np.zeros(ends[-1], np.int32)
    for k, (which, piece) in enumerate(steps):
        ids[ends[which] - 1 - k] = piece
    return ids, ends, first[end], second[end]


class Encoder:
    """Best segmentations of whole texts, put together from those of words; words are remembered up to a bound."""

    def __init__(self, vocabulary: dict, n: int):
        self.vocabulary, self.n = vocabulary, n
        self._forget()

    def _forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.ids, self.ends = array("i"), array("q", [0])
        self.scores, self.losses = array("d"), array("d")  # of the best one; what the second best one loses

    def _learn(self, words: set[str]) -> None:
        alone = self.vocabulary["alone"]
        usual = [w for w in words if len(w) <= SHORT and alone.issuperset(w)]
        for low in range(0, len(usual), 20_000):
            part = usual[low:low + 20_000]
            ids, ends, first, second = best_two_of_all(part, self.vocabulary["trie"])
            self.codes.update(zip(part, range(len(self.codes), len(self.codes) + len(part))))
            self.ends.extend((ends + len(self.ids)).tolist())
            self.ids.extend(ids.tolist())
            self.scores.extend(first.tolist())
            self.losses.extend((first - second).tolist())
        for word in words - self.codes.keys():  # long ones, and those with unknown characters
            ids, first, second = best_two(word, self.vocabulary)
            self.codes[word] = len(self.codes)
            self.ids.extend(ids)
            self.ends.append(len(self.ids))
            self.scores.append(first)
            self.losses.append(first - second)

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, float, list[dict]]]:
        """For each text: ids, score, and the other n - 1 best as score and changed words (place, ids)."""
        cut = [words_of(text, self.vocabulary) for text in texts]
        if len(self.codes) > REMEMBERED:
            self._forget()
        self._learn(set().union(*cut) - self.codes.keys())
        ids, ends = np.array(self.ids), np.array(self.ends)
        scores, losses = np.array(self.scores), np.array(self.losses)
        for words in cut:
            codes = np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words))
            starts, sizes = ends[codes], ends[codes + 1] - ends[codes]
            shift = np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
            score = float(scores[codes].sum())
            yield ids[shift + np.arange(len(shift))], score, self._others(words, losses[codes], score)

    def _others(self, words: list[str], losses: np.ndarray, score: float) -> list[dict]:
        """Of two segmentations of a text, the one that changes a word with a smaller loss is better, so only the n - 1
        words with the smallest losses (the first ones of equal) can differ from the best in the n best."""
        k = min(self.n - 1, len(words))
        if k < 1:
            return []
        limit = np.partition(losses, k - 1)[k - 1]
        less = np.flatnonzero(losses < limit)
        places = sorted([*less, *np.flatnonzero(losses == limit)[:k - len(less)]])
        lists = [n_best(words[p], self.n, self.vocabulary) for p in places]
        ways = [(sum(one[i][0] - one[0][0] for one, i in zip(lists, way)), way)
                for way in product(*[range(len(one)) for one in lists])]
        ways.sort(key=lambda w: (-w[0], w[1]))
        return [{"score": score + gain, "words": [{"word": int(p), "ids": one[i][1]} for p, one, i in zip(places, lists, way) if i]}
                for gain, way in ways[1:self.n]]


ENCODED = StructType([
    StructField("ids", ArrayType(IntegerType())), StructField("score", DoubleType()),
    StructField("others", ArrayType(StructType([
        StructField("score", DoubleType()),
        StructField("words", ArrayType(StructType([StructField("word", IntegerType()), StructField("ids", ArrayType(IntegerType()))]))),
    ]))),
])
OTHERS = pa.list_(pa.struct([("score", pa.float64()), ("words", pa.list_(pa.struct([("word", pa.int32()), ("ids", pa.list_(pa.int32()))])))]))


def encoder(spark: SparkSession, vocabulary: dict, n: int = N_BEST):
    shared = spark.sparkContext.broadcast(vocabulary)

    @F.arrow_udf(ENCODED)
    def encode_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Encoder(shared.value, n)
        for batch in batches:
            rows = list(own.encode([text or "" for text in batch.to_pylist()]))
            ends = np.cumsum([0, *[len(ids) for ids, _, _ in rows]]).astype(np.int32)
            flat = np.concatenate([ids for ids, _, _ in rows], dtype=np.int32) if rows else np.zeros(0, np.int32)
            yield pa.StructArray.from_arrays(
                [pa.ListArray.from_arrays(ends, pa.array(flat, pa.int32())), pa.array([s for _, s, _ in rows], pa.float64()),
                 pa.array([o for _, _, o in rows], OTHERS)], names=["ids", "score", "others"])

    return encode_batches


def decoder(spark: SparkSession, vocabulary: dict):
    shared = spark.sparkContext.broadcast(vocabulary["text"])

    @F.arrow_udf(StringType())
    def decode_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        spelled = pa.array(shared.value, pa.large_binary())
        for batch in batches:
            counts = batch.value_lengths().fill_null(0).to_numpy()
            data = spelled.take(batch.flatten())
            _, offsets, joined = data.buffers()
            places = np.frombuffer(offsets, np.int64)[data.offset + np.concatenate([[0], np.cumsum(counts)])] if len(data) else np.zeros(len(counts) + 1, int)
            text = joined.to_pybytes() if len(data) else b""
            # without the blank in front
            yield pa.array([text[a:b][1:].decode("utf-8", "replace") for a, b in zip(places, places[1:])], pa.string())

    return decode_batches


def encode(docs: DataFrame, text: str = "text", into: str = "pieces", n: int = N_BEST, model: str = MODEL) -> DataFrame:
    """`docs` with a struct `into`: ids and score of the best segmentation of the whole text, and the others of the n best.

    Each of `others` has a score and the words that it segments differently (their place among the words cut before
    blanks and around line feeds, and their ids); there are fewer than n - 1 if the text has fewer segmentations. Equal
    scores are kept in the order the search finds them, then by the earlier word unchanged. Null and empty texts
    have no ids and score 0; a single very long word is one lattice, linear in its length. Rows are independent:
    repeated rows get equal ids, columns may have any name but `into`, an empty table gives no rows.
    """
    return docs.withColumn(into, encoder(docs.sparkSession, load(model), n)(F.col(text)))


def decode(docs: DataFrame, ids: str, into: str = "decoded", model: str = MODEL) -> DataFrame:
    """`docs` with a column `into`: the text of an array of ids; null and empty arrays give the empty text."""
    return docs.withColumn(into, decoder(docs.sparkSession, load(model))(F.col(ids)))


@query("op9_pieces")
def op9(spark, sf_dir):
    found = encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = decode(found.withColumn("ids", F.col("pieces.ids")), "ids")
    return found.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_pieces"), F.xxhash64("ids").alias("ids_xxhash64"), F.col("pieces.score").alias("score"),
        F.transform("pieces.others", lambda o: o["score"]).alias("other_scores"),
        (F.col("decoded") == F.coalesce(F.col("text"), F.lit(""))).alias("round_trip"),
    )
