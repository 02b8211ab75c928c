"""Each operator against a brute-force version, with nulls, empty and very long texts, ties, repeats and odd columns."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as public
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftline.llm import byte_bpe, chat_format, components, embedding_dedup, license_scan, packing, pii, quality_rules, simhash, suffix_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, key string, block long, _th string, _base string, _id string, _h string, fp string, component string, _words string, kept string"
WORD = r"[^\x20\x09-\x0D]+"


def docs(spark, texts, parts=3):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", "y", 1, *"abcdefgh") for i, t in texts], SCHEMA).repartition(parts)


def corpus(n=60, seed=1):
    """Texts with exact and near copies, shared passages, and awkward ones."""
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "the", "of", "ünï", "x1", "and", "über"]
    passage = " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(30))
    out = []
    for i in range(n):
        text = " ".join(rng.choice(words) + str(rng.randrange(90)) for _ in range(rng.randrange(1, 120)))
        if i % 5 == 0:
            text = text[: len(text) // 2] + passage + text[len(text) // 2 :]
        if i % 9 == 4:
            text = out[rng.randrange(len(out))][1] or ""
        if i % 13 == 7:
            text = (out[-1][1] or "") + " tail"
        out.append((i * 3, text))
    out += [(1, None), (2, ""), (4, " \n\t "), (5, "é" * 3000), (7, "a b " * 4000), (8, "é" * 3000), (10, "short"), (10, "short"), (None, "no id " * 20)]
    return out


EMPTY = "spark.createDataFrame([], SCHEMA)"


def by_id(df):
    return {r.doc_id: r for r in df.collect() if r.doc_id is not None}


def test_byte_bpe(spark):
    path = public.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    plain = tiktoken.Encoding("t", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [*corpus(20), (1000, "tab\tand  spaces \n\n end  "), (1001, "no-break and \x1c control"), (1002, "don't we'll I'VE"), (1003, "abc" * 700), (1004, "<|endoftext|> 😀😀")]
    found = byte_bpe.digest_documents(docs(spark, texts), path, public.PATTERN)
    rows = {(r.doc_id, r.decoded_sha256): r for r in found.collect()}
    assert found.count() == len(texts)
    for i, t in texts:
        ids = np.array(plain.encode_ordinary(t or ""), "<u4").tobytes()
        r = rows[i, hashlib.sha256((t or "").encode()).hexdigest()]
        assert (r.n_tokens, r.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
    own = byte_bpe.encode_documents(docs(spark, texts[:5]), path, public.PATTERN).collect()
    assert all(bytes(r.decoded).decode() == (dict(texts)[r.doc_id] or "") for r in own)
    assert byte_bpe.digest_documents(spark.createDataFrame([], SCHEMA), path, public.PATTERN).count() == 0


def test_segment_tree_forms_agree():
    ranks = byte_bpe.read_ranks(public.path("byte_bpe_50k.tiktoken"))
    bpe = byte_bpe.SegmentTreeBPE(ranks)
    rng = random.Random(2)
    pieces = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 60))).encode() for _ in range(200)]
    assert bpe.encode(pieces) == [bpe._one(p) if p not in ranks else ranks[p].to_bytes(4, "little") for p in pieces]


@pytest.mark.parametrize("size", [1024, 64])
def test_packing(spark, size):
    texts = [*corpus(40), (900, "word " * 3000), (901, "a <|endoftext|> b<|endoftext|><|endoftext|>"), (902, "<|endoftext")]
    tokenizer = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    rows = packing.pack_documents(docs(spark, [t for t in texts if t[0] not in (10, None)]), public.path("byte_bpe_50k.json"), public.PATTERN, size).collect()
    for i, t in texts:
        if i in (10, None):
            continue
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        assert all(r.length == size for r in own[1:]) and all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append(r)
    for own in bins.values():
        end = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= size
    assert len(bins) <= 1.15 * -(-sum(r.length for r in rows) // size) + 1
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), public.path("byte_bpe_50k.json"), public.PATTERN).count() == 0


def first_fit_decreasing(histogram, size):
    bins = []
    for length in range(size, 0, -1):
        for _ in range(histogram[length]):
            at = next((k for k, used in enumerate(bins) if used + length <= size), None)
            if at is None:
                bins.append(length)
            else:
                bins[at] += length
    return len(bins)


@pytest.mark.parametrize("lo,hi,n,size", [(1, 128, 700, 128), (40, 100, 500, 128), (30, 50, 600, 128), (1, 20, 900, 128), (128, 128, 5, 128), (7, 7, 100, 128)])
def test_packing_plans_place_every_piece(lo, hi, n, size):
    histogram = np.bincount(np.random.default_rng(3).integers(lo, hi + 1, n), minlength=size + 1)
    plan, solution = packing.rounded(histogram, size, 40)
    used = sum(times for _, times in plan)
    assert (sum(c * times for c, times in plan) == histogram).all()
    assert all(c @ np.arange(size + 1) <= size for c, _ in plan)
    assert solution.bound <= used + 1e-6 and int(histogram @ np.arange(size + 1)) <= (solution.bound + 1) * size
    assert used <= first_fit_decreasing(histogram, size) and [(c.tolist(), k) for c, k in packing.plan_of(histogram, size)] == [(c.tolist(), k) for c, k in plan]


def test_packing_uses_its_linear_program():
    """On lengths of a corpus the LP's configurations hold most pieces, and the plan is as short as its bound."""
    rng = np.random.default_rng(5)
    histogram = np.bincount(np.minimum(1 + rng.lognormal(5, 1, 20_000).astype(int), 512), minlength=513)
    plan, solution = packing.rounded(histogram, 512, 40)
    used = sum(times for _, times in plan)
    assert solution.value >= 0.7 * used and used <= solution.bound + 2


def test_packing_prices_move():
    """Where the longest pieces can't share, their price rises to a whole sequence and that of short ones falls."""
    histogram = np.zeros(129, np.int64)
    histogram[[70, 80, 50]] = 100
    price, bound = packing.prices(histogram, 128, 40)
    assert bound > 199 and price[80] > 0.95 and price[50] < 0.2


def expected_quality(text):
    words = re.findall(WORD, text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    inside = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), n < 50 or 100 * len(inside) > 50 * n


def test_quality_base_and_verdict(spark):
    rng = random.Random(5)
    good = [(i, " ".join(rng.choice(["the", "of", "and", "house", "river", "to", "was", "green", "stone", "in", "that", "walks"]) + rng.choice(["", "", "s", f"{rng.randrange(99)}"]) for _ in range(200)) + "\nsame line here\nsame line here") for i in range(40)]
    junk = [(100, " ".join("ABC!!!%%% $$$" for _ in range(9)) + " " + " ".join(f"Q{k}!!%%" for k in range(90)))]
    texts = [*good, *junk, *[(i + 1000 if i is not None else None, t) for i, t in corpus(30)]]
    found = quality_rules.judge_documents(docs(spark, texts))
    rows = found.collect()
    assert len(rows) == len(texts)
    for i, t in texts:
        want = expected_quality(t or "")
        assert any(tuple(r)[1:7] == want for r in rows if r.doc_id == i), i
    kept = {r.doc_id: r.kept for r in rows}
    assert all(kept[i] for i, _ in good) and not kept[100]
    assert all(not r.kept for r in rows if r.base_failed)
    stage = quality_rules.keep_good(docs(spark, texts))
    assert stage.columns == docs(spark, texts[:1]).columns and sorted(str(r.doc_id) for r in stage.collect()) == sorted(str(r.doc_id) for r in rows if r.kept)
    assert quality_rules.judge_documents(spark.createDataFrame([], SCHEMA)).count() == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def right(kind, value):
    digits = [int(c) for c in value if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def test_pii(spark):
    rng = random.Random(7)
    alphabet = "ab1.@+-_% ()é9\n"
    texts = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 120)))) for i in range(150)]
    hard = ["a@b.c_d@e.f.g", "1.2.3.4.5.6.7.8 300.1.1.1 0000255.1.2.3", "4532-0151-1283-0366 4532 0151 1283 0366  12", "+1 (555) 555-0000 +1((((", "é😀 a.b@c.d 4539578763621486", "1 " * 6000, "1" * 50000, "a" * 50000 + "@", "", None, "4111111111111111-4111111111111111", "+12345678+12345678", "4532-0151-1283-0366  4532 0151 1283 0366  12"]
    hard += [f'key token = "{hashlib.sha1(str(k).encode()).hexdigest()}" end' for k in range(9)] + ['see token = "Zz9-short-but-4-secret" there']
    texts += [(1000 + i, t) for i, t in enumerate(hard)]
    found = by_id(pii.find(docs(spark, texts)))
    for i, t in texts:
        base = [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, t or "") if right(k, m[0])]
        assert found[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), t
        assert found[i].spans.startswith(",".join(base))
    assert "secret:13:35" in found[1000 + len(hard) - 1].spans  # its shape is no seed's: the context tells
    clean = pii.redact(docs(spark, texts))
    rows = by_id(clean)
    assert rows[1002].text == hard[2]  # one chain of 32 digits is no card, and what fails isn't tried again
    row = rows[1012]
    assert row.text == "[card]  [card]  12" and row.n_chars == len(row.text) and clean.columns == docs(spark, texts[:1]).columns
    assert pii.find(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pii_upper_case_shares_evidence(spark):
    secrets = [hashlib.sha1(str(k).encode()).hexdigest() for k in range(9)]
    texts = [(k, f'key token = "{s}" end') for k, s in enumerate(secrets)] + [(50, f'KEY TOKEN = "{"0AF9" * 9}" END'), (51, f'A TOKEN = "{secrets[0].upper()}" B')]
    found = by_id(pii.find(docs(spark, texts)))
    assert (found[50].spans, found[51].spans) == ("secret:13:49", "secret:11:51")
    loud = by_id(pii.find(docs(spark, [(k, f'MY TOKEN = "{s.upper()}"') for k, s in enumerate(secrets)])))
    assert all(r.n_secret == 1 for r in loud.values())  # upper-case secrets are seeds themselves


def test_pii_tight_fields_and_whole_values(spark):
    secrets = [hashlib.sha1(str(k).encode()).hexdigest() for k in range(9)]
    texts = [(k, f'word{k} of api_key={s} and w{k} token = "{s}" or {{"MY_LONG_FIELD_NAME":"{s}"}}') for k, s in enumerate(secrets)]
    hard = ["x api_key=ab.cd.", "x api_key=short, y", 'see token = "two words, 3.5" there', 'Token = "no-digits-at-all-here"', "api_key=", '"my_long_field_name":"é😀"', "api_key=aaaa.bbbb0123456789012345", None, "the key is short"]
    want = ["ab.cd", "short", "two words, 3.5", "no-digits-at-all-here", None, "é😀", "aaaa.bbbb0123456789012345", None, None]
    rows = by_id(pii.find(docs(spark, [*texts, *((100 + k, t) for k, t in enumerate(hard))])))
    assert all(rows[k].n_secret == 3 for k, _ in texts)
    for k, (t, v) in enumerate(zip(hard, want, strict=True)):
        assert rows[100 + k].spans == (f"secret:{t.index(v)}:{t.index(v) + len(v)}" if v else ""), t


def test_pii_patterns_of_later_generations(spark):
    """Values that a confident field holds make another field confident, which finds values that no seed stands beside."""
    hexes = [hashlib.sha1(str(k).encode()).hexdigest() for k in range(9)]
    mixed = [f"Zz{k}-{'qr' * 6}-{k}x{k}" for k in range(12)]  # of no seed's shape
    # fields whose values were all found, never seeds: two hops from any seed
    far = [(k, f'a token = "{h}" b') for k, h in enumerate(hexes)] + [(20 + k, f'a token = "{m}" b') for k, m in enumerate(mixed)]
    far += [(40 + k, f"c vault_ref: {m} d") for k, m in enumerate(mixed)] + [(60, "e vault_ref: last-word f")]
    few = [(t, x) for t, x in far if t < 9 or t in (20, 21) or t >= 40]
    assert by_id(pii.find(docs(spark, few)))[60].spans == "" and "vault_ref: " not in {r.context for r in pii.patterns_of(docs(spark, few)).collect()}
    many = far + [(100 + k, f'a token = "{hashlib.sha1(str(100 + k).encode()).hexdigest()}" b') for k in range(120)]
    assert by_id(pii.find(docs(spark, many)))[60].spans == "secret:13:22"


def test_pii_patterns_by_joins_are_those_by_constants(spark):
    secrets = [hashlib.sha1(str(k).encode()).hexdigest() for k in range(9)]
    texts = [(k % 7, f'w{k} token = "{s}" and api_key={s}, key: "x {k}" a@b.cd') for k, s in enumerate(secrets)] + [(None, 'no id token = "short"'), (50, None), (51, "")]
    one = sorted(map(str, pii.find(docs(spark, texts)).collect()))
    two = sorted(map(str, pii.find(docs(spark, texts), pii.Limits(inline=0)).collect()))
    assert one == two and sum(r.n_secret for r in pii.find(docs(spark, texts)).collect()) >= 19
    clean = [sorted(str(r) for r in pii.redact(docs(spark, texts), pii.Limits(inline=n)).collect()) for n in (0, 200)]
    assert clean[0] == clean[1]


def test_pii_text_of_very_many_spans(spark):
    text = "a@b.cd " * 60_000
    row = pii.find(docs(spark, [(1, text)])).collect()[0]
    assert row.n_email == 60_000 and row.spans.endswith(f"email:{len(text) - 7}:{len(text) - 1}")


@pytest.mark.parametrize("size", [3000, 1 << 20])
def test_suffix_dedup(spark, size):
    texts = corpus(60)
    rows = suffix_dedup.digest_documents(docs(spark, texts), 50, size).collect()
    assert len(rows) == len(texts)
    seen = {}
    ordered = sorted(((i, (t or "").encode()) for i, t in texts if i is not None), key=lambda x: x[0])
    for i, b in ordered:
        for p in range(len(b) - 49):
            seen.setdefault(b[p : p + 50], i)
    for i, b in ordered:
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if seen[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        r = next(r for r in rows if r.doc_id == i)
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()), i
    assert next(r for r in rows if r.doc_id is None).n_removed == 0
    stage = suffix_dedup.remove_repeats(docs(spark, texts))
    assert stage.columns == docs(spark, texts[:1]).columns and stage.count() == len(texts)
    assert suffix_dedup.digest_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_suffix_messages_are_for_several_blocks(spark):
    """A row from each bucket to each block would grow with the square of the input."""
    rng = random.Random(5)
    passages = ["".join(rng.choice("abcdefghij ") for _ in range(70)) for _ in range(300)]
    texts = [(k, "|".join(rng.sample(passages, 300)) + f" {k}") for k in range(24)]
    blocks = suffix_dedup.blocks_of(docs(spark, texts, 1).select("doc_id", "text"), 1000)
    assert blocks.count() == len(texts)
    messages = suffix_dedup.repeated_spans(blocks)
    assert messages.count() <= 0.7 * 2 * 64 * len(texts)  # two passes of 64 buckets


def test_suffix_digits_are_dealt_evenly(spark, monkeypatch):
    """Hashes of anchors are the least of many: dealt by their own leading bits, most would meet in the first bucket."""
    rng, rows, deal = random.Random(6), [], suffix_dedup._by_bucket
    monkeypatch.setattr(suffix_dedup, "_by_bucket", lambda found, settle: rows.append(found.select("bucket", "data").collect()) or deal(found, settle))
    texts = [(k, "".join(rng.choice("abcdefghij ") for _ in range(20000))) for k in range(4)]
    suffix_dedup.repeated_spans(suffix_dedup.blocks_of(docs(spark, texts).select("doc_id", "text")))
    sizes = Counter()
    for r in rows[0]:
        sizes[r.bucket] += int.from_bytes(r.data[:4], "little")
    assert max(sizes.values()) <= 4 * sum(sizes.values()) / 64

def test_suffix_passes_read_a_block_or_so_at_a_time(spark, monkeypatch, tmp_path):
    """Batches of all a task's rows are held several times over, and make executors large for good."""
    rng, frame, log = random.Random(7), type(spark.range(0)), tmp_path / "sizes"
    real = frame.mapInArrow

    def spied(self, f, schema):
        def run(batches):
            def seen(batch):
                with log.open("a") as out:
                    out.write(f"{batch.num_rows} {batch.nbytes}\n")
                return batch

            return f(seen(b) for b in batches)

        return real(self, run, schema)

    monkeypatch.setattr(frame, "mapInArrow", spied)
    texts = [(k, rng.randbytes(2000).hex()) for k in range(3000)] + [(3000, rng.randbytes(2 << 20).hex())]
    names = ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = [spark.conf.get(k, None) for k in names]
    messages = suffix_dedup.repeated_spans(suffix_dedup.blocks_of(docs(spark, [*texts, (3001, texts[5][1])], 1).select("doc_id", "text")))
    assert messages.count() and before == [spark.conf.get(k, None) for k in names]
    sizes = [tuple(map(int, line.split())) for line in log.read_text().splitlines()]
    assert sum(n for _, n in sizes) > 12e6
    assert all(rows == 1 or size < 2 * suffix_dedup.BLOCK + (4 << 20) for rows, size in sizes)



def plain_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def least_reachable(names, linked):
    parent = {n: n for n in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in names}


def test_golay_code_is_perfect_and_two_errors_share_a_key():
    table = simhash.golay()
    assert len(np.unique(table)) == 4096 and (np.bincount(table) == 2048).all()
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 23, 500).astype(np.uint32)
    flips = (np.uint32(1) << rng.integers(0, 23, 500).astype(np.uint32)) | (np.uint32(1) << rng.integers(0, 23, 500).astype(np.uint32))
    (a, has_a), (b, has_b) = simhash.codewords(words), simhash.codewords(words ^ flips)
    assert all(set(a[i][has_a[i]]) & set(b[i][has_b[i]]) for i in range(500))


@pytest.mark.parametrize("wide", [False, True])
def test_simhash_links(spark, wide):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(30)]
    prints = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(0, 6))) for b in base for _ in range(30)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = components.connected_components(simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long").repartition(5), wide))
    got = {r.id: r.component for r in found.collect()}
    want = least_reachable(signed, [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 4])
    assert all(got.get(s, s) == want[s] for s in signed)


def test_simhash_documents(spark):
    texts = [*corpus(60), (500, "Ünique WORDS İ kept, not folded"), (501, "three words only")]
    found = simhash.near_duplicates(docs(spark, texts)).collect()
    assert len(found) == len(texts)
    assert sorted(r.fp & (2**64 - 1) for r in found) == sorted(plain_print(t) for _, t in texts)
    prints = {i: plain_print(t) for i, t in texts if i is not None}
    want = least_reachable(sorted(prints), [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4])
    assert all(r.component_id == want[r.doc_id] for r in found if r.doc_id is not None)
    kept = simhash.keep_one(docs(spark, texts)).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted([*map(str, {w for w in want.values()}), "None"])
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 999), (999, 1000), (7, 7)]
    got = {r.id: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long").repartition(6)).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[1000] == got[999] == 999


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    centre = rng.standard_normal(16)
    rows = [centre.tolist()] * 4 + [(centre + rng.standard_normal(16) * 0.03).tolist() for _ in range(30)] + [rng.standard_normal(16).tolist() for _ in range(80)]
    rows += [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [1.0, 2.0], [2.0, 4.0], [-0.0, 1.0], [0.0, 1.0], (centre * 3).tolist()]
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    usable = [i for i, v in enumerate(rows) if v and None not in v and np.isfinite(v).all() and np.any(v)]
    near = lambda a, b: len(rows[a]) == len(rows[b]) and np.dot(rows[a], rows[b]) >= 0.95 * np.linalg.norm(rows[a]) * np.linalg.norm(rows[b])
    linked = [(a, b) for a in usable for b in usable if a < b and near(a, b)]
    want, many = least_reachable(list(range(len(rows))), linked), Counter(x for pair in linked for x in pair)
    for r in embedding_dedup.near_duplicates(df.repartition(3)).collect():
        assert (r.n_links, r.component_id, r.kept) == (many[r.vec_id], want[r.vec_id], want[r.vec_id] == r.vec_id), r
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_without_ids_and_of_one_id(spark):
    rows = [(None, [1.0, 0.0]), (5, [2.0, 0.0]), (7, [1.0, 0.001]), (None, [0.0, 1.0]), (None, [0.0, 1.0]), (9, [1.0, -1.0]), (9, [-1.0, 1.0]), (None, None)]
    found = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)).collect()
    assert len(found) == len(rows)
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in found)
    assert got == sorted([("None", 2, "5"), ("5", 2, "5"), ("7", 2, "5"), ("None", 1, "None"), ("None", 1, "None"), ("9", 0, "9"), ("9", 0, "9"), ("None", 0, "None")])


def test_embeddings_sparse_pairs_beside_a_cluster(spark):
    rng = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    base = unit(rng.standard_normal((200, 32)))
    away = rng.standard_normal(base.shape)
    away = unit(away - (away * base).sum(1)[:, None] * base)
    x = np.concatenate([unit(base[0] + 0.002 * rng.standard_normal((200, 32))), base, 0.955 * base + np.sqrt(1 - 0.955**2) * away])
    near = unit(x) @ unit(x).T >= 0.95
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    few = embedding_dedup.Settings(neighbours=1, tables=1, rounds=0, most_tables=1)
    for audit in (8, 128):  # linked nodes beside the cluster, or all nodes outside it
        rows = embedding_dedup.near_duplicates(df, embedding_dedup.Settings(**{**vars(few), "audit": audit})).collect()
        assert {r.vec_id: r.n_links for r in rows} == dict(enumerate(near.sum(1).tolist()))


def test_chat_format(spark):
    control = "</s>[INST] ok [/INST]"
    turns = [(1, 0, "user", control), (1, 1, "assistant", control), (2, 1, "assistant", "b\\<[\\"), (2, 0, "user", None), (2, 1, "assistant", "b\\<[\\"), (3, 0, "weird]role[TEXT]", "[/ROLE]"), (3, 1, None, ""), (4, 0, "system", "s"), (4, 1, "user", "u"), (4, 2, "assistant", "<<SYS>>"), (None, 0, "user", "x")]
    df = spark.createDataFrame([(*t, "extra") for t in turns], "conv_id long, turn long, role string, text string, seq string").repartition(4)
    segments = chat_format.format_conversations(df)
    found = {r.conv_id: r for r in chat_format.read_back(segments).collect()}
    for c in (1, 2, 3, 4, None):
        own = sorted((t, r or "", x or "") for cc, t, r, x in turns if cc == c)
        said = "".join(x for _, r, x in own if r == "assistant")
        r = found[c]
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in own).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert (found[1].valid, found[2].valid, found[3].valid, found[4].valid) == (True, False, False, True)
    whole = "".join(r.segment for r in segments.where("conv_id = 1").orderBy("seq", "part").collect())
    assert whole.count("[INST]") == 1 and whole.count("</s>") == 1 and len(whole) == found[1].formatted_chars
    assert chat_format.read_back(chat_format.format_conversations(df.limit(0))).count() == 0


def test_licenses(spark):
    own = license_scan.model()
    for family, texts in license_scan.TEMPLATES.items():
        assert all(license_scan.judge(license_scan.words_of(t), own)[0] == family for t in texts)
    assert not any(v[0] != "unknown" and v[2] >= 0.6 for t in license_scan.UNKNOWN if (v := license_scan.judge(license_scan.words_of(t), own)))
    texts = [(1, "intro\nReleased under the MIT License.\nmore"), (2, "He lost his driving license."), (3, None), (4, "Copyright\n\nLicensed under the Apache License,\nVersion 2.0."), (4, "Copyright\n\nLicensed under the Apache License,\nVersion 2.0."), (5, "word " * 20000 + "\nLicensed under CC BY-NC 4.0."), (6, "")]
    texts += [(10 + k, t) for k, t in enumerate(license_scan.UNKNOWN)]
    found = license_scan.scan_documents(docs(spark, texts)).collect()
    assert len(found) == len(texts)
    got = {r.doc_id: r.families for r in found}
    assert (got[1], got[2], got[3], got[4], got[5]) == ("mit", "", "", "apache-2.0", "cc-by-nc")
    assert all(got[10 + k] == "" for k in range(len(license_scan.UNKNOWN)))


def test_licenses_equal_their_plain_form(spark):
    """Every document's counts from its paragraphs, judged one at a time."""
    own = license_scan.model()
    trigger = re.compile(license_scan.TRIGGERS)
    parts = [t for texts in license_scan.TEMPLATES.values() for t in texts] + [*license_scan.UNKNOWN, "no word of it", "Permission is granted", "licence", "MIT License and GNU General Public License, version 3"]
    rng = random.Random(8)
    texts = [(k, ("\n\n" if k % 3 == 0 else "\n").join(rng.sample(parts, rng.randrange(1, 6)))) for k in range(80)] + [(900, None), (901, ""), (902, parts[0]), (902, parts[0])]
    rows = license_scan.scan_documents(docs(spark, texts)).collect()
    assert len(rows) == len(texts)
    for i, t in texts:
        t = t or ""
        paragraphs = re.split(r"\n[ \t]*\n", t) if re.search(r"\n[ \t]*\n", t) else t.split("\n")
        seen = [license_scan.judge(license_scan.words_of(p), own) for p in paragraphs if trigger.search(p)]
        confirmed = [f for f, _, share in seen if f != "unknown" and share >= 0.6]
        want = (",".join(sorted(set(confirmed))), len(confirmed), sum(f != "unknown" and share < 0.6 for f, _, share in seen), sum(f == "unknown" for f, _, _ in seen))
        assert all(tuple(r)[1:] == want for r in rows if r.doc_id == i), (i, want)
    assert license_scan.scan_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_licenses_in_paragraphs_without_a_word_of_licences(spark):
    """Families and confirmed paragraphs are those of judging every paragraph, lines of wrapped notices included."""
    own, trigger, rng = license_scan.model(), re.compile(license_scan.TRIGGERS), random.Random(3)
    lines = ["Unauthorized copying of this file, via any medium, is strictly prohibited.", "in the Software without restriction, including without limitation the rights to use, copy, modify,", "To the extent possible under law, the authors have waived all"]
    assert not any(map(trigger.search, lines))
    words = [license_scan.words_of(t) for texts in license_scan.TEMPLATES.values() for t in texts]
    cuts = [" ".join(w[at : at + 8]) for w in words for at in range(0, len(w), 8)]
    prose = ["Nicht mit dem Boot, mit der Bahn.", "MIT", "the of and in", "word"]
    texts = [(k, t) for k, t in enumerate(lines)] + [(100 + k, "\n".join(rng.sample(cuts + lines + prose, 6))) for k in range(60)] + [(900, "\n".join(cuts)), (901, None), (902, ""), (None, lines[0])]
    rows = license_scan.scan_documents(docs(spark, texts)).collect()
    assert len(rows) == len(texts)
    got = {r.doc_id: r for r in rows}
    assert [got[k].families for k in (0, 1, 2, None)] == ["proprietary", "mit", "cc0", "proprietary"]
    for i, t in texts:
        seen = [license_scan.judge(license_scan.words_of(p), own) for p in (t or "").split("\n")]
        confirmed = [f for f, _, share in seen if f != "unknown" and share >= 0.6]
        assert (got[i].families, got[i].n_confirmed) == (",".join(sorted(set(confirmed))), len(confirmed)), (i, t)


def test_license_identifiers_and_calibration(spark):
    lines = {"// SPDX-License-Identifier: MIT": "mit", "# SPDX-License-Identifier: Apache-2.0": "apache-2.0", "SPDX-License-Identifier: GPL-3.0-or-later": "gpl", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products": "bsd"}
    found = {r.doc_id: r.families for r in license_scan.scan_documents(docs(spark, list(enumerate(lines)))).collect()}
    assert [found[k] for k in range(len(lines))] == list(lines.values())
    own = license_scan.model()
    judged = [(f, license_scan.judge(license_scan.words_of(t), own)[0]) for f, texts in license_scan.CALIBRATION.items() for t in texts]
    assert sum(f == g for f, g in judged) >= 0.8 * len(judged)  # texts that training never saw
    assert not any(license_scan.judge(license_scan.words_of(t), own)[2] >= 0.6 for t in license_scan.CALIBRATION_UNKNOWN)


def test_toxicity(spark):
    rng = random.Random(9)
    plain = ["stone", "river", "walk", "green", "house", "tree", "cloud", "road"]
    texts, labels = [], []
    for i in range(400):
        words = [rng.choice(plain) + str(rng.randrange(30)) for _ in range(40)]
        bad = i % 4 == 0
        if bad:
            words[rng.randrange(40)] = rng.choice(["Nasty!", "vile", "rotten."])
        texts.append((i, " ".join(words)))
        labels.append((i, 1, int(bad) if rng.random() > 0.03 else 1 - int(bad)))
    texts += [(5000, None), (5001, ""), (5002, "x" * 200000), (None, "vile")]
    df, marks = docs(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = toxicity.score_documents(df, toxicity.train(df, marks)).collect()
    assert len(found) == len(texts) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found if r.doc_id is not None)
    held = [r for r in found if r.held_out and r.doc_id < 400]
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in held) >= 0.95 * len(held)
    none = toxicity.train(df, marks.limit(0))
    assert none.lexicon == () and none.score("anything") < 1e-6
    assert toxicity.train(df, marks.withColumn("toxic", F.lit(1))).score("") > 0.99


def test_toxic_words_rarer_than_many_common_parts(spark):
    rng = random.Random(3)
    common = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvw") for _ in range(9)) for _ in range(5000))  # over 20,000 parts
    texts = [(1, common + (" zyxvile" if k < 30 else "")) for k in range(40)] + [(0, common)] * 60
    sample = spark.createDataFrame([(t, x) for t, x in texts], "toxic long, text string").repartition(4)
    found = toxicity._toxic_entries(sample, 64, 5)
    assert found and all(e.startswith("zyx") for e in found)
