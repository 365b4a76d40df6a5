"""Conversation repair, word-end BPE and spelling variants against brute force, SQL and the installed library."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from featlens.llm import conversations, spelling, wordbpe
from featlens.llm.queries import WORD_ENDS, vocabulary
from tests.conftest import SF001

FOLLOWS = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
NAMES = {"u": "user", "a": "assistant"}


@pytest.mark.parametrize("name", ["op11_turn_repair", "op13_spelling_variants"])
def test_oracle_agrees(spark, name):
    df = E.queries()[name](spark, SF001)
    got = Counter(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    cur = con.execute(E.oracle_sql()[name])
    order = sorted((d[0], k) for k, d in enumerate(cur.description))
    assert got and got == Counter(tuple(r[k] for _, k in order) for r in cur.fetchall())


# ------------------------------------------------------------------ conversations

def damaged(rows):
    conv = defaultdict(list)
    for c, t, r, x in rows:
        r, x = (" " if v is None else v for v in (r, x))
        f = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        conv[c] += [] if f == 0 else [(t, "user" if f == 4 else r, "" if f == 1 else re.sub("[.!?]", "", x) if f == 2 else x)] * (2 if f == 3 else 1)
    for v in conv.values():
        v.sort(key=lambda z: (z[0] is not None, z[0] or 0, z[1].encode(), hashlib.md5(f"{z[1]}\0{z[2]}".encode()).hexdigest()))
    return conv


def inserted(best):
    """Every state with its best insertions ahead: (cost, audit, rows)."""
    best = dict(best)
    for _ in range(4):
        for s in range(4):
            for letter, name in NAMES.items():
                if FOLLOWS[s].get(letter) in best:
                    cost, audit, rows = best[FOLLOWS[s][letter]]
                    new = (cost + 3, "I" + audit, [("I", name, ""), *rows])
                    if s not in best or new[:2] < best[s][:2]:
                        best[s] = new
    return best


def expected(rows):
    out = {}
    for c, v in damaged(rows).items():
        turns, seen, fault = {t for t, _, _ in v if t is not None}, set(), []
        for _, r, x in v:
            body = x.strip(conversations.BLANKS)
            fault.append("blank" if not body else "duplicate" if (r, x) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((r, x))
        best = inserted({0: (0, "", []), 3: (0, "", [])})
        for (_, r, x), wrong in reversed(list(zip(v, fault))):
            now, pay = {}, 3 * (wrong == "truncated")
            for s, (cost, audit, rest) in best.items():
                now[s] = [(cost + 4, "D" + audit, rest)]
            for s in range(4):
                if wrong not in ("blank", "duplicate"):
                    for letter, name in [(r[:1], None), *NAMES.items()]:
                        if FOLLOWS[s].get(letter) in best:
                            cost, audit, rest = best[FOLLOWS[s][letter]]
                            now.setdefault(s, []).append((cost + pay + 3 * (name is not None), ("R" if name else "K") + audit, [("R" if name else "K", name or r, x), *rest]))
            best = inserted({s: min(ways, key=lambda w: w[:2]) for s, ways in now.items()})
        cost, audit, done = best[0]
        initials = [r[:1] for _, r, _ in v]
        out[c] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *map(fault.count, ("blank", "duplicate", "truncated")),
                  sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                  hashlib.sha256("\n".join(f"{r}:{x}" for _, r, x in done).encode()).hexdigest(), done)
    return out


@pytest.fixture(scope="module")
def talks(spark):
    rng, rows = random.Random(3), []
    for c, n in [(None, 40), (1, 600), (2, 150), (3, 40), (4, 40)]:
        for t in range(n):
            turn = None if rng.random() < .1 else t if rng.random() < .9 else rng.randrange(n)
            role = rng.choice(["user", "assistant", "user", "assistant", "system", None, "tool", "", "s"])
            rows.append((c, turn, role, rng.choice(["a.", "b!", "c", "", " \n", None, "d. ", f"x{rng.randrange(400)}", f"y{t}."])))
            rows += rows[-1:] * (rng.random() < .05)
    rows += [(9, t, None, f"q{t}.") for t in range(300)]                        # roles that never fit: costs never forget the end
    rows += [(10, 3, "user", "again.")] * 500 + [(10, 4, "assistant", "z" * 200_000), (11, 0, "user", None)]
    rows += [(12, t, None, None) for t in range(50)]                            # nothing stays
    return rows


@pytest.mark.parametrize("size", [conversations.CHUNK, 5, 1])
def test_repair_equals_brute_force_whatever_the_chunks(spark, talks, size):
    df = spark.createDataFrame(talks, "conv_id long, turn long, role string, text string").withColumn("cost", F.lit("x")).withColumn("id", F.lit(1))
    got = {r[0]: tuple(r[1:]) for r in conversations.digest(df, size).collect()}
    assert got == {c: w[:-1] for c, w in expected(talks).items()}


def test_repaired_rows(spark, talks):
    df = conversations.damage(spark.createDataFrame(talks, "conv_id long, turn long, role string, text string"))
    _, _, told = conversations.repair(df, 64)
    found = defaultdict(list)
    for r in sorted(conversations.repaired(conversations.tidy(df), told).collect(), key=lambda r: r.position):
        found[r.conv_id].append((r.edit, r.role, r.text))
    assert found == {c: w[-1] for c, w in expected(talks).items() if w[-1]}
    assert all(re.fullmatch("(s?(ua)+)?", "".join(r[:1] for _, r, _ in v)) for v in found.values())


def test_no_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.digest(df).count() == 0
    zero = [(t, "x") for t in range(3000) if zlib.crc32(f"{t}:0".encode()) % 20 == 0][:1]
    gone = conversations.digest(spark.createDataFrame([(zero[0][0], 0, "user", "x")], df.schema)).collect()
    assert [tuple(r)[1:] for r in gone] == [(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_vectors_forget_where_they_started():
    rng = random.Random(1)
    symbols = bytes(rng.choice([0, 1, 2, 5, 6, 8]) for _ in range(400))
    a, b = conversations.backward(symbols, conversations.END), conversations.backward(symbols, conversations._pack([5, 2, 0, 3]))
    assert a[:300] == b[:300] and conversations.backward(symbols, conversations._pack([5, 2, 0, 3]), a) == b


# ------------------------------------------------------------------ word-end BPE

@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(vocabulary(WORD_ENDS))


def samples():
    rng = random.Random(2)
    yield from [None, "", "  \n", "a<|endoftext|>b <|startoftext|>x<|ENDOFTEXT|>", "can't WON'T I'LL 'S", "ΑΣ ΟΔΟΣ", "é é ́a", "a\x1cb\x85c\xa0d　e​f",
                "日本語テキスト 12345", "\U0001F600\U0001F468‍\U0001F469", "İstanbul ǅ ß ŉ", "</w> a</w>b", "x" * 3000, "\x00\x01", "a!!!??? b"]
    for letters, n in (("aelnorst", 14), ("ahe", 40), ("a!.'s -1é日ßΣ́ \n", 30)):
        yield from ("".join(rng.choices(letters, k=rng.randint(1, n))) for _ in range(3000))
    yield from ("".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 1000), rng.randint(0x4e00, 0x5000), rng.randint(0, 0xd7ff)])) for _ in range(20)) for _ in range(3000))
    yield "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=300_000))


def test_ids_equal_the_library(library):
    encoder, texts = wordbpe.Encoder(wordbpe.parsed(wordbpe.load(vocabulary(WORD_ENDS)))), list(samples())
    want = library.encode_batch([t or "" for t in texts], add_special_tokens=False)
    for _ in range(2):      # anew, then remembered
        assert [g.tolist() for g in encoder.encode(texts)] == [w.ids for w in want]


def test_every_token_is_its_own_encoding():
    v = wordbpe.parsed(wordbpe.load(vocabulary(WORD_ENDS)))
    assert {w: ids for w, ids in v.words(list(v.final)).items() if ids != (v.final[w],)} == {}


def test_word_bpe_digest_and_round_trip(spark, library):
    texts = list(samples())[:2000]
    df = spark.createDataFrame([(i if i % 7 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    source = wordbpe.load(vocabulary(WORD_ENDS))
    want = Counter()
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        told = library.decode(ids, skip_special_tokens=False)
        want[(i if i % 7 else None, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(told.encode()).hexdigest())] += 1
    assert Counter(map(tuple, wordbpe.digest(df, source).collect())) == want
    again = wordbpe.decode(wordbpe.encode(df, source), source)
    assert again.columns == ["doc_id", "ids", "text"]
    assert Counter(map(tuple, again.select("doc_id", F.sha2("text", 256)).collect())) == Counter({(k[0], k[3]): 0 for k in want} | Counter((k[0], k[3]) for k in want.elements()))
    assert wordbpe.digest(df.where("false"), source).count() == 0


def test_other_files_are_refused():
    import json
    with open(vocabulary(WORD_ENDS), encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"]["merges"].insert(0, ["th", "e</w>"])
    with pytest.raises(ValueError):
        wordbpe.Vocabulary(json.dumps(spec))
    with open(vocabulary("byte_bpe_50k.json"), encoding="utf-8") as f, pytest.raises(ValueError):
        wordbpe.Vocabulary(f.read())


# ------------------------------------------------------------------ spelling variants

def spelled(rows, least, damage):
    count = Counter()
    for i, t in rows:
        for w in re.findall(f"{spelling.LETTER}+", t or ""):
            w = w.translate(str.maketrans(spelling.UPPER, spelling.LOWER))
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            count[w if not damage or h % damage else w[:h % len(w)] + w[h % len(w) + 1:]] += 1
    n = {w: k for w, k in count.items() if k >= least and len(w) >= 6}
    near = {w: {x for x in n if x != w and abs(len(x) - len(w)) < 2 and one_edit(*sorted((w, x), key=len))} for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        if best and n[best] >= 5 * n[w]:
            form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return out


def one_edit(a, b):
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)):] == b[k + 1:]


@pytest.mark.parametrize("damage", [None, 3])
def test_variants_equal_brute_force(spark, damage):
    rng, rows = random.Random(4), []
    words = ["banana", "bananna", "banaana", "bannana", "aaaaaa", "aaaaaaa", "aaaaaaaa", "baaaaa", "Étange", "étange", "ètange", "étanges", "étaange", "ÿÿÿÿÿÿ", "naïveté", "naiveté"]
    words += ["".join(rng.choices("ab", k=rng.randint(5, 8))) for _ in range(60)]
    for i in range(120):
        rows.append((rng.choice([None, i, i]), rng.choice([" ", "1", "-"]).join(rng.choice(words[:1 + int(len(words) * rng.random() ** 2)]) for _ in range(rng.randint(0, 60)))))
    rows += [(1, None), (2, ""), (3, "x" * 100_000), *[(4, "frequent word, ")] * 40, (4, "frequens frequens frequens frequens frequens frequenz " * 2)]
    df = spark.createDataFrame([(i, t, 1, "y") for i, t in rows], "doc_id long, text string, n int, word string")
    got = [tuple(r) for r in spelling.variants(df, damage=damage).collect()]
    want = spelled(rows, 5, damage)
    assert len(got) == len(want) and set(got) == want and any(w[1] for w in want)


def test_long_chains_of_forms(spark):
    names = ["aaaaaa" + "b" * k for k in range(9)]
    df = spark.createDataFrame([(w, 5 ** (k + 1)) for k, w in enumerate(names)], "word string, n long")
    got = {r.word: (r.form, r.root) for r in spelling.group(df).collect()}
    assert got == {w: (names[k + 1] if k < 8 else None, names[-1]) for k, w in enumerate(names)}
    assert spelling.group(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        spelling.group(df, ratio=1)
