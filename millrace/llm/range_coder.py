"""Token-ID / binary output: an adaptive context-mixing range coder.

Token ids are coded in blocks, each with a model and coder of its own, so a block can be decoded alone and a damaged one
harms no other; a CRC-32 of the ids shows damage. An id is one step of the range coder, whose interval comes from a mixture
of three predictions:

- order 0: the counts of the block's ids so far, over a flat start that leaves no id without a chance;
- order 1 and order 2: the id that came last after the same one id or two ids, each with a confidence, the number of times
  in a row that this context's prediction was right.

The mixture's weights are learned: for each state (both confidences and whether the two agree) the block's hits so far give
the weight of each prediction, and order 0 has the rest. Counts and hits enter at fixed places of a block, after 32, 64, 128
and 256 ids and then every 256. So what the encoder's model knows at each place follows from sorted contexts and running sums
of the whole block, a few array operations an id, and only the coder itself goes id by id, with all blocks of a task in
lockstep. The coder is a carry-less range coder with 64-bit low and 16-bit output. The decoder is written apart from the
encoder, id by id with dictionaries.

A document's ids may span blocks, and a block holds parts of many documents: ``doc_ids`` and ``counts`` say which ids are
whose. Blocks are filled from one partition after another, so their number depends on the partitioning (each partition's
last block may be short); the ids that they hold do not. Cases: NULL texts are not coded, and empty ones have a count of 0.
A NULL id stays NULL in ``doc_ids``. Repeated rows are coded each for itself. Ids up to 65,535 fit. An empty table gives no
blocks. Other columns are not used. The document id is an integer, or a string that is one.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._shared import batches
from millrace.llm.token_files import FILE, FOLDER, encoding

BLOCK, LANES = 16_384, 1024
VOCABULARY, LONGEST = 1 << 16, 1 << 18  # ids, and the most of them in a block
TOTAL = 27  # bits of the coder's frequency scale
ORDERS = (1 << TOTAL) // 64 * 63  # what orders 1 and 2 can get of it
GAIN = 64  # weight of a count against the flat start's 1 for each id
STATES = 128  # two confidences of 0 to 7, and agreement
SCHEMA = "doc_ids array<long>, counts array<int>, n_tokens int, crc long, payload binary"


def prior() -> tuple[np.ndarray, np.ndarray]:
    """Of 64 imagined places of each state, how often order 2 and order 1 were right; as order 2 if they agree."""
    rate = np.array([0, 24, 36, 44, 50, 54, 57, 60])
    s = np.arange(STATES)
    c2, c1, agree = s >> 4, (s >> 1) & 7, s & 1
    first = np.where(agree, np.maximum(rate[c2], rate[c1]), rate[c2])
    return first, np.where(agree, 0, np.where(c2 == 0, rate[c1], (64 - first) * rate[c1] // 96))


FIRST, SECOND = prior()


def places(n: int) -> list[int]:
    """Where counts and hits enter: the starts of a block's segments."""
    out, step = [0], 32
    while out[-1] + step < n:
        out.append(out[-1] + step)
        step = min(256, out[-1])
    return out


def gain(block: int) -> int:
    """What a count weighs: GAIN, or less where a block is so long that the flat start would have no room."""
    return max(1, min(GAIN, (1 << 20) // max(1, block)))


def _guesses(key: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """key: sorted (context << 18 | place of the context's last id). For the places whose context was there before:
    (place, what followed last time, confidence)."""
    follows = (key & (LONGEST - 1)) + 1
    if len(follows) and follows.max() == len(ids):
        inside = follows < len(ids)
        key, follows = key[inside], follows[inside]
    came, i = ids[follows], np.arange(len(key))
    same = (key[1:] ^ key[:-1]) < LONGEST
    hit = np.zeros(len(key), bool)
    hit[1:] = same & (came[1:] == came[:-1])
    missed = np.maximum.accumulate(np.where(hit, 0, i))  # the last place so far, in the table's order, that was no hit
    last = np.flatnonzero(same)
    return follows[last + 1], came[last], np.minimum(last - missed[last], 6) + 1


def intervals(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(low, width) of each id's interval of 2^TOTAL, as the model has it at the id's place."""
    n = len(ids)
    if n > LONGEST:
        raise ValueError(f"a block has at most {LONGEST} ids")
    if not n:
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    x, t, g, starts = ids.astype(np.int64), np.arange(n), gain(n), np.array(places(n))
    k = len(starts)
    seg = np.repeat(np.arange(k), np.diff(np.append(starts, n)))
    one = np.sort((x << 18) | t)
    new = np.ones(n, bool)
    new[1:] = (one[1:] ^ one[:-1]) >= LONGEST
    rank = np.empty(n, np.int64)
    rank[one & (LONGEST - 1)] = np.cumsum(new) - 1
    kinds = int(new.sum())
    # order 0: how many smaller ids, and how many up to the id itself, there were at its segment's start
    ranked = np.zeros((k + 1, kinds + 1), np.int32)
    ranked[1:, 1:] = np.bincount(seg * kinds + rank, minlength=k * kinds).reshape(k, kinds)
    np.cumsum(ranked, axis=0, out=ranked)
    np.cumsum(ranked, axis=1, out=ranked)
    cell, ranked = seg * (kinds + 1) + rank, ranked.ravel()
    below = ranked[cell].astype(np.int64)
    width0, low0 = 1 + g * (ranked[cell + 1] - below), x + g * below
    # orders 1 and 2
    guess1, guess2, sure1, sure2 = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    at, what, sure = _guesses(one, x)
    guess1[at], sure1[at] = what, sure
    at, what, sure = _guesses(np.sort((((x[:-1] << 16) | x[1:]) << 18) | t[1:]), x)
    guess2[at], sure2[at] = what, sure
    agree = (guess1 == guess2) & (sure1 > 0) & (sure2 > 0)
    state = seg * STATES + ((sure2 << 4) | (sure1 << 1) | agree)
    right2, right1 = (guess2 == x) & (sure2 > 0), (guess1 == x) & (sure1 > 0) & ~agree

    def earlier(which: np.ndarray) -> np.ndarray:
        c = np.bincount(which, minlength=k * STATES).reshape(k, STATES)
        return np.cumsum(c, axis=0) - c

    seen = 64 + 4 * earlier(state)
    weight2 = (ORDERS * (FIRST + 4 * earlier(state[right2])) // seen).ravel()[state]
    weight1 = (ORDERS * (SECOND + 4 * earlier(state[right1])) // seen).ravel()[state]
    rest, total0 = (1 << TOTAL) - weight1 - weight2, (VOCABULARY + g * starts)[seg]
    low = low0 * rest // total0
    width = (low0 + width0) * rest // total0 - low
    low += weight1 * (guess1 < x) + weight2 * (guess2 < x)
    width += weight1 * right1 + weight2 * right2
    return low.astype(np.uint32), width.astype(np.uint32)


_U = np.uint64
_FULL, _BOT, _TOP, _LOW = _U(2**64 - 1), _U(1 << 32), _U(1 << 48), _U((1 << 32) - 1)


def encode_blocks(blocks: list[np.ndarray], lanes: int = LANES) -> list[bytes]:
    """The coded form of each block of ids."""
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    out: list[bytes] = [b""] * len(blocks)
    for a in range(0, len(order), lanes):
        part = order[a : a + lanes]
        for i, p in zip(part, _encode_lanes([blocks[i] for i in part])):
            out[i] = p
    return out


def _encode_lanes(blocks: list[np.ndarray], step: int = 128) -> list[bytes]:
    """Blocks by falling length, all at once."""
    n, size = len(blocks), np.array([len(b) for b in blocks])
    longest = int(size[0])
    lows, widths = np.zeros((n, longest), np.uint32), np.zeros((n, longest), np.uint32)
    for j, b in enumerate(blocks):
        lows[j, : len(b)], widths[j, : len(b)] = intervals(b)
    low, rng = np.zeros(n, _U), np.full(n, _FULL, _U)
    words, pos = np.zeros((n, longest * 3 // 4 + 16), np.uint16), np.zeros(n, np.int64)
    for t0 in range(0, longest, step):
        most = int(pos.max()) + 6 * step + 8  # four words a step are the most, and the decoder's start
        if most > words.shape[1]:
            words = np.concatenate([words, np.zeros((n, max(most - words.shape[1], longest // 4)), np.uint16)], axis=1)
        a, f = (np.ascontiguousarray(m[:, t0 : t0 + step].T).astype(_U) for m in (lows, widths))
        going = np.searchsorted(-size, -np.arange(t0, t0 + len(a))).tolist()  # the lanes whose block goes on
        for t, live in enumerate(going):
            lo, ra, r = low[:live], rng[:live], rng[:live] >> _U(TOTAL)
            lo += r * a[t, :live]
            np.multiply(r, f[t, :live], out=ra)
            small = np.flatnonzero(ra < _BOT)
            while len(small):
                x, y = low[small], rng[small]
                y = np.where((x ^ (x + y)) >= _TOP, (~x + _U(1)) & _LOW, y)
                at = pos[small]
                words[small, at] = x >> _U(48)
                pos[small] = at + 1
                y <<= _U(16)
                low[small], rng[small] = x << _U(16), y
                small = small[y < _BOT]
    ends = (low[:, None] >> _U(48) - np.arange(0, 64, 16, dtype=_U)).astype(np.uint16)
    return [np.concatenate([words[j, : pos[j]], ends[j]]).astype(">u2").tobytes() if size[j] else b"" for j in range(n)]


def decode_block(payload: bytes, n: int) -> np.ndarray:
    """The n ids of one block."""
    g, full, low_mask = gain(n), (1 << 64) - 1, (1 << 32) - 1
    out: list[int] = []
    starts, count = set(places(n)), np.zeros(VOCABULARY, np.int64)
    cum: list[int] = []
    followed: tuple[dict, dict] = ({}, {})  # context to [what came last, times in a row that it was right]
    seen, right = [64] * STATES, (FIRST.tolist(), SECOND.tolist())
    now_seen, now_right, waiting = list(seen), (list(right[0]), list(right[1])), []
    low, rng, code, at = 0, full, int.from_bytes(payload[:8].ljust(8, b"\0"), "big"), 8
    for t in range(n):
        if t in starts:
            np.add.at(count, waiting, 1)
            waiting = []
            cum = np.concatenate([[0], np.cumsum(1 + g * count)]).tolist()
            now_seen, now_right = list(seen), (list(right[0]), list(right[1]))
        contexts = (out[-1] if t else None, (out[-2], out[-1]) if t > 1 else None)
        found1, found2 = followed[0].get(contexts[0]), followed[1].get(contexts[1])
        c1, c2 = (0 if e is None else min(e[1], 6) + 1 for e in (found1, found2))
        g1, g2 = (0 if e is None else e[0] for e in (found1, found2))
        agree = c1 > 0 and c2 > 0 and g1 == g2
        state = c2 << 4 | c1 << 1 | agree
        w2, w1 = ORDERS * now_right[0][state] // now_seen[state], ORDERS * now_right[1][state] // now_seen[state]
        rest, total0 = (1 << TOTAL) - w1 - w2, cum[-1]
        r = rng >> TOTAL
        v = min(((code - low) & full) // r, (1 << TOTAL) - 1)
        # v without what orders 1 and 2 have below it; x: the id if it is a guess
        x, added = None, 0
        for guess, w in sorted([(g1, w1), (g2, w2)]):
            if not w:
                continue
            a = cum[guess] * rest // total0 + added
            if v < a:
                break
            if x == guess or v < a + (cum[guess + 1] * rest // total0 + added - a) + w:
                x = guess
                break
            added += w
        if x is None:
            x = bisect_right(cum, ((v - added + 1) * total0 - 1) // rest) - 1
        a = cum[x] * rest // total0
        f = cum[x + 1] * rest // total0 - a + w1 * (g1 == x) + w2 * (g2 == x)
        a += w1 * (g1 < x) + w2 * (g2 < x)
        low, rng = (low + r * a) & full, r * f
        while rng < 1 << 32:
            if low ^ ((low + rng) & full) >= 1 << 48:
                rng = -low & low_mask
            code = (code << 16 | int.from_bytes(payload[at : at + 2].ljust(2, b"\0"), "big")) & full
            at, low, rng = at + 2, (low << 16) & full, rng << 16
        seen[state] += 4
        right[0][state] += 4 * (c2 > 0 and g2 == x)
        right[1][state] += 4 * (c1 > 0 and g1 == x and not agree)
        for table, context, e in zip(followed, contexts, (found1, found2)):
            if context is not None:
                table[context] = [x, e[1] + 1 if e is not None and e[0] == x else 0]
        out.append(x)
        waiting.append(x)
    return np.array(out, np.int64)


def decode_blocks(payloads: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    """The ids of blocks; each is decoded alone."""
    return [decode_block(p, n) for p, n in zip(payloads, sizes)]


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u2").tobytes())


def _coder(block: int, lanes: int, folder: str, file: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(folder, file)
        ids: list[np.ndarray] = []  # of the blocks to come
        whose: list[tuple[int | None, int]] = []
        held = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal ids, whose, held
            joined = np.concatenate(ids) if ids else np.zeros(0, np.uint16)
            end = len(joined) if last else len(joined) - len(joined) % block
            blocks = [joined[a : min(end, a + block)] for a in range(0, end, block)]
            owners: list[tuple[list, list]] = [([], []) for _ in blocks]
            b, room, left = 0, block, []
            for doc, n in whose:
                if b >= len(blocks):
                    left.append((doc, n))
                    continue
                if not n:
                    owners[b][0].append(doc)
                    owners[b][1].append(0)
                while n and b < len(blocks):
                    k = min(n, room)
                    owners[b][0].append(doc)
                    owners[b][1].append(k)
                    n, room = n - k, room - k
                    if not room:
                        b, room = b + 1, block
                if n:
                    left.append((doc, n))
            if last and left and not any(n for _, n in left):  # only empty documents remain
                blocks.append(np.zeros(0, np.uint16))
                owners.append(([d for d, _ in left], [0] * len(left)))
                left = []
            if blocks:
                coded = encode_blocks(blocks, lanes)
                yield pa.RecordBatch.from_arrays([
                    pa.array([o[0] for o in owners], pa.list_(pa.int64())), pa.array([o[1] for o in owners], pa.list_(pa.int32())),
                    pa.array([len(x) for x in blocks], pa.int32()), pa.array([checksum(x) for x in blocks], pa.int64()), pa.array(coded, pa.binary()),
                ], ["doc_ids", "counts", "n_tokens", "crc", "payload"])
            ids, whose, held = [joined[end:]], left, len(joined) - end

        for b in batches(it, 4 << 20, column=1):
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t is None:
                    continue
                x = enc.encode_to_numpy(t, disallowed_special=()).astype(np.uint16)
                ids.append(x)
                whose.append((i, len(x)))
                held += len(x)
                if held >= lanes * block:
                    yield from flush(False)
        yield from flush(True)

    return run


def coded_blocks(df: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, lanes: int = LANES, folder: str = FOLDER, file: str = FILE) -> DataFrame:
    """One row a block: (doc_ids, counts, n_tokens, crc, payload). ``decode_blocks`` gives the ids back."""
    slim = df.select(F.col(f"`{doc_id}`").cast("long").alias("i"), F.col(f"`{text}`").alias("t"))
    return slim.mapInArrow(_coder(block, lanes, folder, file), SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    """op10: the token ids of all documents, coded."""
    return coded_blocks(spark.read.parquet(f"{sf_dir}/documents.parquet"))
