"""Every operator against a brute-force version on the edge tables."""

import hashlib
import itertools
import json
import os
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F


from salesloom.llm import bpe, chat, contamination, lines, neardup, oracle, quality, queries, sieve, tokens, urls, warc, wrappers
from salesloom.llm.groups import connected

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_text(rows, *fields):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, str(r["text"]), *(r[f] for f in fields)) for r in rows)


# --- 1: quality rules


def measured(text):
    found = WORD.findall(text or "")
    grams = [tuple(found[k : k + 3]) for k in range(len(found) - 2)]
    hit = {k + d for k, g in enumerate(grams) if grams.count(g) > 1 for d in range(3)} if len(grams) < 2000 else set()
    said = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text or "")), len(said) - len(set(said)), len(hit)


def test_quality_measures(docs):
    out = quality.quality(docs)
    assert out.columns == [*docs.columns, "quality"]
    for r in out.collect():
        q = r["quality"]
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == measured(r["text"])
        assert q.base_failed == (q.n_words < 50 or 100 * q.n_repeat_words > 50 * q.n_words)
        assert not (q.kept and q.broken)


def test_quality_verdicts(docs):
    kept = {r["doc_id"]: r["quality"].kept for r in quality.quality(docs).collect()}
    assert kept[6] and not kept[1] and not kept[13] and not kept[14]
    assert quality.quality(docs.limit(0)).count() == 0


def test_quality_keeps_labelled_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    judged = quality.quality(docs, out="verdict").join(spark.read.parquet(f"{SMALL}/labels.parquet"), "doc_id")
    assert judged.where("not verdict.base_failed and verdict.kept != (quality = 1)").count() == 0


# --- 2 and 10: BPE and token counts


@pytest.fixture(scope="module")
def tool():
    return bpe.encoder(bpe.public_vocabulary())


def exact_ids(tool, text):
    return tool.exact.encode(text, add_special_tokens=False).ids


PIECES = ["a", " ", "\n", "don't", "é", "日本", " ", "\u2003", "  ", bpe.END, "<|endoftext", "x" * 40, "7", "%%", "\t", "🙂", "foo bar"]


@pytest.mark.parametrize("seed", range(30))
def test_chunked_ids_are_the_whole_texts_ids(tool, seed):
    pick = np.random.default_rng(seed)
    text = "".join(pick.choice(PIECES, pick.integers(0, 6000)))
    if seed % 4 == 0:
        text = re.sub(r"\s", "", text)
    ids = tool.encode(text)
    assert ids.tolist() == exact_ids(tool, text)
    assert tool.decode(ids) == tool.exact.decode(ids.tolist(), skip_special_tokens=False) == text


def test_equal_passages_give_equal_chunks(tool):
    passage = " ".join(f"said{k}" for k in range(6000)).encode()
    chunks = [{raw[a:b] for a, b in itertools.pairwise(bpe.chunk_cuts(raw))} for raw in (b"x" * 700 + passage, b"quite another start " * 90 + passage)]
    assert len(chunks[0] & chunks[1]) >= len(chunks[0]) - 3 > 2
    assert all(b"".join(raw[a:b] for a, b in itertools.pairwise(bpe.chunk_cuts(raw))) == raw for raw in (passage, b"", b"a"))


def test_round_trip_digests(docs, none, tool):
    for r in bpe.round_trip(docs.where("doc_id is not null"), bpe.public_vocabulary()).collect():
        texts = [t or "" for k, t in [(d["doc_id"], d["text"]) for d in docs.collect()] if k == r.doc_id]
        ids = exact_ids(tool, texts[0])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[0].encode()).hexdigest()
    assert bpe.round_trip(none, bpe.public_vocabulary()).count() == 0
    coded = bpe.encode(docs, bpe.public_vocabulary(), out="row")
    assert set(coded.columns) == set(docs.columns) and coded.where("size(row) = 0").count() == 2


@pytest.mark.parametrize("rule", tokens.RULES)
def test_token_counts_add_up(docs, none, rule, tool):
    rows = tokens.token_counts(docs, bpe.public_vocabulary(), rule=rule).toPandas()
    sums = rows.groupby(["doc_id", "doc_tokens"], dropna=False).n_tokens.sum()
    copies = {7: 2}
    for (k, total), n in sums.items():
        if k != 12:  # characters cut in two by tokens
            assert n == pytest.approx(total * copies.get(k, 1))
    assert tokens.token_counts(none, bpe.public_vocabulary(), rule=rule).count() == 0


def test_tokens_at_boundaries():
    first, last = np.array([0, 3, 5]), np.array([2, 4, 9])  # three tokens of 3, 2 and 5 characters
    starts, ends = np.array([0, 4, 6]), np.array([4, 6, 10])
    assert tokens.counted(first, last, starts, ends, "first").tolist() == [2, 1, 0]
    assert tokens.counted(first, last, starts, ends, "last").tolist() == [1, 1, 1]
    assert tokens.counted(first, last, starts, ends, "middle").tolist() == [2, 0, 1]
    assert tokens.counted(first, last, starts, ends, "share").tolist() == pytest.approx([1.5, 0.7, 0.8])


def test_given_sections(docs):
    whole, sections = tokens.fields_as_sections(docs, ["words", "text"])
    rows = tokens.token_counts(docs.withColumns({"text": whole, "sections": sections}), bpe.public_vocabulary(), sections="sections")
    assert rows.where("section = 'words' and n_tokens < 1").count() == 0


# --- 3: fuzzy lines


def test_lines_and_their_groups(docs, none):
    rows = {(r.id, r.place): r.kept for r in lines.line_groups(docs).where("id is not null").collect()}
    assert rows[6, 3] and not rows[7, 3] and not rows[8, 3]
    assert rows[9, 1] and not rows[10, 1] and rows[10, 0] and rows[10, 2]
    assert lines.line_groups(none).count() == 0
    out = lines.dedup_lines(docs)
    assert set(out.columns) == {*docs.columns, "n_removed_lines"} and out.count() == docs.count()
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[1] is None and texts[2] == "" and texts[6] == "\n".join(dict.fromkeys(texts[6].split("\n")))
    assert texts[10] == "another begin here\nand the end of ten" and texts[9].count("passage59") == 1


def test_crowded_buckets_lose_no_link(spark):
    """Near copies of one line in buckets of many: groups as from comparing all pairs of a bucket."""
    pick = np.random.default_rng(5)
    base = [f"tok{k}" for k in range(60)]
    said = []
    for k in range(60):
        line = list(base)
        for _ in range(pick.integers(0, 14)):
            line[pick.integers(0, 60)] = f"new{k}x{pick.integers(0, 9)}"
        said.append(" ".join(line))
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(said)], "doc_id long, text string")
    found = lines._occurrences(docs, "doc_id", "text").select("h1", "h2", F.col("id").alias("n"), "normal")
    blocks = {r.n: set(r.blocks) for r in lines._signed(found).collect()}
    assert max(Counter(b for k in blocks.values() for b in k).values()) > 5
    parent = list(range(60))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(range(60), 2):
        if blocks[a] & blocks[b]:
            n = max(len(said[a]), len(said[b]))
            if distance(said[a], said[b]) <= int(0.2 * n + 1e-9):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    got = {r.id: r.kept for r in lines.line_groups(docs).collect()}
    assert got == {k: root(k) == k for k in range(60)} and 1 < sum(got.values()) < 60


def test_lines_are_normalised_once(spark, monkeypatch):
    """What signs the lines reads them normalised, and that copy of the text does not stay in scratch."""
    plans, places, keep = {}, {}, lines.stored

    def watched(frame, name):
        plans[name] = frame._jdf.queryExecution().toString()
        out = keep(frame, name)
        places.setdefault(name, out.inputFiles())
        return out

    monkeypatch.setattr(lines, "stored", watched)
    said = [(k, f"Line {k % 3}, said  more than once!\n...\nOnly {k}: one", "x") for k in range(9)]
    got = lines.line_groups(spark.createDataFrame(said, "doc_id long, text string, other string")).collect()
    assert len(got) == 27 and sum(r.kept for r in got if r.place == 1) == 1
    assert [name for name, plan in plans.items() if "regexp_replace" in plan] == ["line-texts"]
    assert places["line-texts"] and not any(os.path.exists(f.removeprefix("file:")) for f in places["line-texts"])
    assert all(os.path.exists(f.removeprefix("file:")) for f in places["line-occurrences"])


def test_blocks_by_brute_force(spark):
    """Rings of fewer features than votes too: votes go round the ring as often as needed."""
    pick = np.random.default_rng(5)
    rings = [sorted({int(x) for x in pick.integers(-(1 << 63), (1 << 63) - 1, n)}) for n in (*range(1, 10), 40, 200)]
    rows = spark.createDataFrame([(r,) for r in rings], "ring array<long>")
    rows = rows.select("ring", F.sort_array(F.concat("ring", lines._places())).alias("all"), lines._around("ring").alias("around"))
    for r in rows.select("ring", lines._blocks("around", "all").alias("blocks")).collect():
        for place, block in zip(lines.PLACES, r.blocks, strict=True):
            first = sum(x < place for x in r.ring)
            votes = [r.ring[(first + k) % len(r.ring)] % (1 << 64) for k in range(lines.VOTES)]
            want = sum((sum(v >> bit & 1 for v in votes) > lines.VOTES / 2) << bit for bit in range(64))
            assert block % (1 << 64) == want


def test_only_repeated_lines_are_shuffled_with_their_text(spark, monkeypatch):
    plans, keep = {}, lines.stored
    monkeypatch.setattr(lines, "stored", lambda frame, name: plans.setdefault(name, frame._jdf.queryExecution().toString()) and keep(frame, name))
    said = [f"line{k % 30}x alone{k % 30} with{k % 30} words{k % 30}" if k < 50 else f"only{k} here{k}" for k in range(80)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(said)], "doc_id long, text string").repartition(3)
    found = lines._occurrences(docs, "doc_id", "text")
    got = lines._distinct(found, found.drop("normal")).collect()
    want = Counter(said)
    assert {r.normal: r.n for r in got} == want and len(got) == len(want) == len({r.line for r in got})
    signed = lines._signed(found.select("h1", "h2", F.lit(1).cast("long").alias("n"), "normal")).collect()
    blocks = {r.normal: (r.size, r.blocks) for r in signed}
    assert all(blocks[r.normal] == (r.size, r.blocks) and r.blocks for r in got)
    assert not re.search(r"hashpartitioning\(h1#\d+L, h2", plans["lines"]) and re.search(r"hashpartitioning\(h1#\d+L, h2", plans["lines-again"])


def test_shared_ends_do_not_change_the_distance(spark):
    pick = np.random.default_rng(11)
    word = lambda n: "".join(pick.choice(list("abé日🙂"), n))
    said = [("", ""), ("a", ""), ("aaa", "aa"), ("abab", "ab"), ("é日", "é日"), ("x" * 20_000 + "y", "x" * 20_000 + "z")]
    for _ in range(150):
        start, end = word(pick.integers(0, 40)), word(pick.integers(0, 40))
        said.append((start + word(pick.integers(0, 6)) + end, start + word(pick.integers(0, 6)) + end))
    met = spark.createDataFrame([(k, -1, 1, x, y) for k, (x, y) in enumerate(said)], "a long, b long, most int, text_a string, text_b string")
    got = {r.a: r for r in lines._stripped(met).collect()}
    for k, (x, y) in enumerate(said):
        left, right = got[k].text_a, got[k].text_b
        assert left[:1] != right[:1] and left[-1:] != right[-1:] or not (left and right) or len(x) > sum(lines.ENDS)
        if len(x) < 200:
            assert distance(left, right) == distance(x, y)
    assert got[5].text_a == "x" * (20_000 - sum(lines.ENDS)) + "y"
    texts = spark.createDataFrame([(2 * k + j, t) for k, pair in enumerate(said[6:]) for j, t in enumerate(pair)], "line long, normal string")
    pairs = spark.createDataFrame([(2 * k, 2 * k + 1) for k in range(150)], "a long, b long")
    want = {2 * k for k, (x, y) in enumerate(said[6:]) if distance(x, y) <= int(0.2 * max(len(x), len(y)) + 1e-9)}
    assert {r.a for r in lines._linked(pairs, texts, 0.8).collect()} == want and 0 < len(want) < 150


def test_long_near_copies_are_told_by_their_parts(spark):
    """The sum of the parts is never below the distance, is enough for near copies, and decides no pair wrongly."""
    pick = np.random.default_rng(17)
    word = lambda: "".join(pick.choice(list("abcdeé日"), pick.integers(1, 8)))
    said, near = [], set()
    for k in range(120):
        line = [word() for _ in range(pick.integers(60, 140))]
        share = (0.03, 0.08, 0.25, 0.4)[k % 4]
        other = [word() if pick.random() < share else w for w in line]
        said.append((" ".join(line), " ".join(other)))
        near |= {k} if share < 0.1 else set()
    runs = [word() for _ in range(90)]  # every word said often, one time more or less in the copy
    said.append(tuple(" ".join(" ".join([w] * int(n + d)) for w, n, d in zip(runs, sizes, drift)) for sizes in [pick.integers(4, 9, 90)] for drift in (np.zeros(90), pick.integers(-1, 2, 90))))
    near.add(120)
    far = [distance(x, y) for x, y in said[:120]]
    met = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(said)], "a long, x string, y string")
    most = F.floor(0.2 * F.greatest(F.length("x"), F.length("y")) + 1e-9).cast("int")
    for least, sizes in lines.PARTS.items():
        for allowed in (most, F.lit(1 << 20)):
            got = {r.a: r for r in met.select("a", most.alias("most"), lines._in_parts(F.col("x"), F.col("y"), allowed, *sizes).alias("edits")).collect()}
            assert all(got[k].edits >= n or got[k].edits > got[k].most for k, n in enumerate(far))
        told = {k for k in near if got[k].edits <= got[k].most}
        assert len(told - {120}) >= 0.9 * (len(near) - 1) and (least == 256 or 120 in told)
    texts = spark.createDataFrame([(2 * k + j, t) for k, pair in enumerate(said) for j, t in enumerate(pair)], "line long, normal string")
    pairs = spark.createDataFrame([(2 * k, 2 * k + 1) for k in range(121)], "a long, b long")
    want = {2 * k for k, (x, y) in enumerate(said[:120]) if far[k] <= int(0.2 * max(len(x), len(y)) + 1e-9)} | {240}
    assert {r.a for r in lines._linked(pairs, texts, 0.8).collect()} == want and 60 <= len(want) < 121


def test_recall_of_fuzzy_lines(spark):
    """Lines with one word or character changed, told by edit similarity alone; also short and unspaced lines."""
    pick = np.random.default_rng(3)
    word = lambda: "".join(pick.choice(list("abcdefghijklmnoprstuvw"), pick.integers(3, 9)))
    sign = lambda: chr(0x4E00 + int(pick.integers(0, 3000)))
    kinds = {"4": (4, word, " "), "10": (10, word, " "), "20": (20, word, " "), "50": (50, word, " "), "unspaced 20": (20, sign, ""), "unspaced 80": (80, sign, "")}
    said, kind = [], {}
    for name, (n, part, space) in kinds.items():
        for _ in range(60):
            line = [part() for _ in range(n)]
            near = list(line)
            k = pick.integers(0, n)
            near[k] = near[k][:-1] + "z" if name == "4" else part()
            a, b = space.join(line), space.join(near)
            if a != b and distance(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9):
                kind[len(said) + 1] = name
                said += [a, b]
    docs = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    kept = {r.id: r.kept for r in lines.line_groups(docs).collect()}
    assert all(kept[k] for k in kept if k not in kind)
    for name in kinds:
        met = [not kept[k] for k in kind if kind[k] == name]
        assert len(met) > 30 and sum(met) >= 0.9 * len(met), name


def distance(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


# --- 4: decontamination


def contaminated(text, items):
    pattern = re.compile(rb"[0-9a-z\x80-\xff]+")
    said = pattern.findall((text or "").encode().lower())
    hit, found = set(), set()
    for key, item in items:
        of = pattern.findall((item or "").encode().lower())
        for w in [of[k : k + 13] for k in range(max(1, len(of) - 12))] if of else []:
            for k in range(len(said) - len(w) + 1):
                if said[k : k + len(w)] == w:
                    hit |= set(range(k, k + len(w)))
                    found.add(key)
    return len(said), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(said)


ITEMS = [(1, PASSAGE := " ".join(f"passage{k}" for k in range(60))), (2, "one, TWO"), (3, None), (4, "..."), (5, PASSAGE), (6, "NAÏVE café"), (7, "naïve CAFÉ café")]


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_contamination(spark, docs, none, monkeypatch, broadcast):
    monkeypatch.setattr(contamination, "BROADCAST_ROWS", broadcast)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = contamination.decontaminate(docs, items)
    assert out.columns == [*docs.columns, "contamination"] and out.count() == docs.count()
    for r in out.collect():
        assert tuple(r["contamination"]) == contaminated(r["text"], ITEMS)
    assert contamination.decontaminate(docs, items.limit(0)).where("contamination.contaminated").count() == 0
    assert contamination.decontaminate(none, items).count() == 0


# --- 5: chat


TURNS = [
    (1, 0, "system", "be <|brief|> \\ <\\|"),
    *[(1, k, "user" if k % 2 else "assistant", f"turn {k} " * (k % 7 * 9)) for k in range(1, 30)],
    (2, 0, "assistant", None),
    (2, 0, "assistant", None),
    (2, 1, "as\nsistant +%", ""),
    (3, 0, None, "<|im_end|>\n<|im_start|>assistant\nno"),
    (4, 0, "user", "long " * 5000),
    (4, 1, "assistant", "<|im_end|>"),
    (None, 0, "assistant", "nobody's"),
]


@pytest.mark.parametrize("budget", [60, 400, 1024])
def test_chat_reads_back(spark, budget):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    windows = chat.chat_windows(turns, budget=budget, history_tokens=budget // 4)
    got = {r.conv: r for r in chat.read_back(windows).collect()}
    for conv in {t[0] for t in TURNS}:
        of = sorted((t[1], t[2] or "", t[3] or "") for t in TURNS if t[0] == conv)
        loss = "".join(x for _, role, x in of if role == "assistant")
        assert got[conv].n_turns == len(of)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in of).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for w in windows.collect():
        assert w.n_tokens <= budget or w.new_turns == 1
        assert conv_starts(w.formatted) == ("system" if w.conv == 1 else conv_starts(w.formatted))
    assert chat.read_back(chat.chat_windows(turns.limit(0))).count() == 0


def conv_starts(formatted):
    return formatted.removeprefix(chat.START).split("\n")[0]


# --- 6: near duplicates


def brute_groups(texts, size, percent):
    sets = {k: neardup.shingles(t, size) for k, t in texts.items()}
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), root(k), root(k) == k) for k in sets}


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, none, size, percent):
    texts = {k: t for k, t in [(r["doc_id"], r["text"]) for r in docs.collect()] if k is not None}
    rows = neardup.near_duplicates(docs, size=size, percent=percent).collect()
    assert len(rows) == docs.count()
    want = brute_groups(texts, size, percent)
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == want[r.doc_id]
    assert neardup.near_duplicates(none).count() == 0


def test_crowds_of_near_copies(spark, monkeypatch):
    """Common content in several blocks: links as from comparing all pairs."""
    monkeypatch.setattr(neardup, "LIST", 4)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    pick = np.random.default_rng(2)
    base = [f"w{k}" for k in range(120)]
    texts = {}
    for k in range(90):
        said = list(base)
        for _ in range(pick.integers(0, 9)):
            said[pick.integers(0, 120)] = f"n{k}"
        texts[k] = " ".join(said[: 120 - int(pick.integers(0, 12))])
    texts |= {100 + k: f"alone{k} " + " ".join(f"own{k}x{j}" for j in range(30)) + " " + " ".join(base[:12]) for k in range(20)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect()}
    assert got == brute_groups(texts, 3, 85)


def test_connected_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in connected(links).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100}


def test_sieve_keeps_every_wanted_key(spark, monkeypatch):
    """Few bits let more rows through, and never lose one; a null key passes only if it is wanted."""
    frame = spark.createDataFrame([(k, f"t{k}") for k in range(500)] + [(None, "none")], "id long, text string")
    wanted = frame.where("id % 7 = 3").select("id")
    want = {k for k in range(500) if k % 7 == 3}
    for rows in (1 << 20, 1):
        monkeypatch.setattr(sieve, "ROWS", rows)
        kept = [r.id for r in sieve.sifted(frame, wanted, "id").collect()]
        assert want <= set(kept) and len(kept) == len(set(kept))
        if rows > 1:
            assert len(kept) < 100 and None not in kept
    assert sieve.sifted(frame, wanted.limit(0), "id").count() == 0
    assert None in [r.id for r in sieve.sifted(frame, frame.where("id is null").select("id"), "id").collect()]


# --- 7: HTML


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li>Menu<li>Two</ul></nav>
<div id="cookie-notice">We use</div><article><h1>Head &amp; line</h1><p><b>First&nbsp; text<br>goes on<p>Second <i>one</i>.
<ul><li>a<li>b</ul><div class="ad">Buy</div><section class="comments"><p>bad</p></section></article>
<script>var t = "</p><article>no</article>";</script><aside>Side</aside><footer>&copy; F"""


def test_extraction(spark):
    rows = [(1, "http://a.test/1", PAGE), (2, "http://a.test/2", None), (3, None, ""), (4, "http://b.test/", "<p>plain <!-- x"), (4, "http://b.test/", "<p>plain <!-- x"), (5, "http://c.test", "<nav>only</nav>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in wrappers.extract(pages, wrappers.infer_wrappers(pages)).collect()}
    assert got[1].text == "Head & line\n\nFirst text goes on\n\nSecond one.\n\na\n\nb"
    assert [got[k].text for k in (2, 3, 5)] == ["", "", ""] and got[4].text == "plain" and got[1].n_chars == len(got[1].text)
    assert wrappers.extract(pages.limit(0), wrappers.infer_wrappers(pages.limit(0))).count() == 0


def test_wrappers_accept_all_pages(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    import json

    found = {r.host: json.loads(r.wrapper) for r in wrappers.infer_wrappers(pages).collect()}
    for r in pages.collect():
        assert wrappers.accepts(found[wrappers._hosts([r.url])[0]], wrappers.page_slots(r.html)[0])


def extracted(spark, pages):
    frame = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in wrappers.extract(frame, wrappers.infer_wrappers(frame)).orderBy("page_id").collect()]


def test_articles_outside_one_place(spark):
    """Articles directly in the body, fragments, text of main around an article, two templates on one host."""
    body = "<html><body><nav>menu</nav><h1>head</h1><p>a long first text</p><ul><li>point</ul><blockquote>said</blockquote><table><tr><td>cell</table></body></html>"
    whole = "head\n\na long first text\n\npoint\n\nsaid\n\ncell"
    pages = [("http://a.test/1", body), ("http://b.test/1", "<div><h2>top</h2><p>more of it</p></div>"), ("http://c.test/1", "<main><h1>name</h1><article><p>inside</p></article></main>")]
    pages += [("http://d.test/1", "<html><body><div><p>the longer text of a first template</p></div></body></html>"), ("http://d.test/2", "<html><body><section><h2>other</h2><p>text</p></section></body></html>")]
    assert extracted(spark, pages) == [whole, "top\n\nmore of it", "name\n\ninside", "the longer text of a first template", "other\n\ntext"]


def test_constant_text_goes(spark):
    """A notice without any mark on all pages of a host is template text; copies of one page are no evidence."""
    page = lambda k: f"<article><h1>title {k}</h1><p>We are moving house</p><p>text {k}</p></article>"
    got = extracted(spark, [(f"http://a.test/{k}", page(k)) for k in range(4)] + [(f"http://b.test/{k}", page(0)) for k in range(4)])
    assert got == [f"title {k}\n\ntext {k}" for k in range(4)] + ["title 0\n\nWe are moving house\n\ntext 0"] * 4


def test_wrappers_in_bounded_groups(spark, monkeypatch):
    """Many templates of one host: no group above the bound, and one wrapper that accepts all."""
    monkeypatch.setattr(wrappers, "TOGETHER", 4)
    streams = [[x for n, e in enumerate(("p", "h2", "ul", "pre", "table")) if k >> n & 1 for x in (e, f"#{e}")] + ["hr"] for k in range(32)]
    frame = spark.createDataFrame([("h", json.dumps(x)) for x in streams] + [("one", "[]")], "host string, wrapper string")
    sizes = wrappers._dealt(frame).groupBy("host", "part").count().collect()
    assert sorted(r["count"] for r in sizes) == [1] + [4] * 8
    html = ["<div>" + "".join(f"<{e}>t{k}{e}</{e}>" for n, e in enumerate(("h1", "h2", "h3", "pre", "dl")) if k >> n & 1) + "<hr></div>" for k in range(32)]
    pages = spark.createDataFrame([(k, "http://h/", x) for k, x in enumerate(html)], "page_id long, url string, html string")
    (found,) = wrappers.infer_wrappers(pages).collect()
    assert all(wrappers.accepts(json.loads(found.wrapper), wrappers.page_slots(x)[0]) for x in html)


def test_alignment():
    a, b = ["h", "p", "p", "p", "f"], ["h", "x", "p", "f"]
    both = wrappers.aligned(wrappers.folded(a), b)
    assert wrappers.accepts(both, a) and wrappers.accepts(both, b) and not wrappers.accepts(both, ["h", "f", "p"])


# --- 8: WARC


def test_archives(spark):
    same = "é" * 60
    rows = [(3, "http://a/ b\r\n", same), (2, "http://b/%20", same), (9, None, same), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (None, "u", same)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder = warc.archive_folder(spark)
    index = warc.write_archives(pages, folder)
    got = {r.page_id: r for r in warc.read_records(index, folder).collect()}
    for page, url, html in rows:
        raw, r = (html or "").encode(), got[page]
        again = html == same and page != 2
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 2) if again else ("response", None))
        assert r.url == (url or "") and r.payload == (None if again else raw)
    assert warc.read_records(index.where("page_id in (2, 9)"), folder).count() == 2
    empty = warc.archive_folder(spark)
    assert warc.read_records(warc.write_archives(pages.limit(0), empty), empty).count() == 0


def test_ranges_are_coalesced():
    rows = [("a", 0, 10), ("a", 10, 5), ("a", 15 + warc.GAP, 5), ("a", 30 + 2 * warc.GAP, 5), ("b", 0, 7)]
    assert [r[:3] for r in warc.coalesced(rows)] == [("a", 0, 20 + warc.GAP), ("a", 30 + 2 * warc.GAP, 35 + 2 * warc.GAP), ("b", 0, 7)]


# --- 9: URLs


def judged(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best and best.verdict


URLS = [None, "", "no scheme", "http://WWW.Example.com/en/x?q#f", "https://example.com/en/", "https://notexample.com/en/", "http://a.net/fr/1", "http://a.net?x=/fr/",
        "http://net/es/", "a://b://c/d", "http://com", "http://com/", "://x.org/É?", "http://spam-farm.example.org/en/1", "http://É.COM/"]


def test_url_filter(spark):
    pages = spark.createDataFrame([(u, "x", "y") for u in URLS], "url string, host string, grams string")
    model = urls.train(urls.labelled_urls(spark))
    out = urls.url_filter(pages, model)
    assert out.columns == ["url", "host", "grams", "url_filter"] and out.count() == len(URLS)
    for r in out.collect():
        f = r["url_filter"]
        host, path, rule, verdict = judged(r["url"])
        assert (f.host, f.path, f.rule) == (host, path, rule) and f.verdict in ("allow", "block") and (not verdict or f.verdict == verdict)
    assert urls.url_filter(pages.limit(0), model).count() == 0


def test_url_model_on_held_out_labels(spark):
    from pyspark.sql import functions as F

    rows = urls.labelled_urls(spark)
    fold = F.pmod(F.xxhash64("url"), F.lit(4))
    right = 0
    for k in range(4):
        model = urls.train(rows.where(fold != k))
        out = urls.url_filter(rows.where(fold == k), model, rules=())
        right += out.where("(url_filter.verdict = 'block') = (label = 1)").count()
    assert right >= 0.7 * rows.count()


# --- the registered queries


def test_queries_match_sql(spark):
    from compare import connect, difference

    db = connect(SMALL)
    for name, sql in oracle.oracle_sql().items():
        assert difference(queries.queries()[name](spark, SMALL), db, sql) is None


def test_warc_tasks_follow_the_bytes(spark):
    """Index rows are few bytes; the archives they point to decide how many tasks read."""
    folder = warc.archive_folder(spark)
    pages = spark.createDataFrame([(k, f"http://h{k}/", hashlib.sha512(str(k).encode()).hexdigest() * 2000) for k in range(40)], "page_id long, url string, html string")
    index = warc.write_archives(pages.repartition(4), folder)
    size = index.agg(F.sum("length")).first()[0]
    read = warc.read_records(index, folder)
    assert read.rdd.getNumPartitions() == min(size >> 20, 8) + 1
    assert {r.page_id: r.payload.decode() for r in read.collect()} == {r.page_id: r.html for r in pages.collect()}


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = corpus_pipeline.run(spark, SMALL)
    assert 0 < rows.count() < docs.count() and rows.where("n_tokens != size(ids) or not same_text").count() == 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SMALL).count() == 0
        assert stage(spark, docs.limit(20), SMALL).columns == docs.columns


def shingles_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def test_pipeline_near_duplicates_by_brute_force(spark):
    """Rows of one id with different texts, null ids and texts, repeated rows, near copies, a long text."""
    import corpus_pipeline

    body = [f"word{k} of{k % 7}" for k in range(60)]
    texts = [
        (1, " ".join(body)), (1, "another text of the same id that says something else"), (2, " ".join(body)),
        (3, " ".join(body[:-1] + ["changed"])), (4, None), (4, None), (5, ""), (None, "no id but a text of its own here"),
        (None, "no id but a text of its own here"), (None, "and one more without an id to be found"), (6, "alone and never seen before now"),
        (6, "alone and never seen before now"), (7, " ".join(f"long{k}" for k in range(30_000))),
    ]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in dict(corpus_pipeline.STAGES)["near duplicates"](spark, docs.repartition(3), SMALL).collect()]
    sets = [shingles_of(t) for _, t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    assert len(got) == len(set(group)) and set(got) <= set(texts)
    kept = Counter(group[texts.index(r)] for r in got if r[1])
    assert set(kept.values()) == {1}
    assert got.count((4, None)) == 2 and got.count((5, "")) == 1


def test_pipeline_other_stages_on_odd_rows(spark):
    import corpus_pipeline

    passage = spark.read.parquet(f"{SMALL}/benchmark.parquet").where("length(text) > 200").first().text
    texts = [(1, None), (1, ""), (None, passage), (2, "plain words only " * 30), (2, "other words of one id"), (3, passage), (3, passage)]
    docs = spark.createDataFrame([(k, t, "en", "s", 0, "x", "y") for k, t in texts], "doc_id long, text string, lang string, source string, n_chars long, key string, row string")
    stages = dict(corpus_pipeline.STAGES)
    left = stages["benchmark decontamination"](spark, docs, SMALL).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in left) == sorted((str(k), str(t)) for k, t in texts if t != passage)
    coded = stages["bpe"](spark, docs, SMALL).collect()
    assert len(coded) == len(texts) and all(r.same_text and r.n_tokens == len(r.ids) for r in coded)


