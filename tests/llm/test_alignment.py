"""Cross-tokenizer alignment (operator 13) against a plain version that encodes whole texts and looks at every byte."""

import bisect
import hashlib
import os
import random
import subprocess
import sys
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from gridlight.llm import alignment
from gridlight.llm.bpe import byte_characters


def plain(rows, weight="n"):
    """Every row of the operator, from whole texts: groups by common ends, links by overlapping ranges, counts over all rows."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    back = {c: k for k, c in enumerate(byte_characters())}
    names = {i: t for t, i in a.get_vocab().items()}
    of_a = lambda i: bytes(back[c] for c in names[i])

    def of_b(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    docs, counts = [], Counter()
    for doc_id, text in rows:
        want = (" " + (text or "")).encode()
        ia, ib = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        if text == "":
            ia = ib = []
        if b"".join(map(of_a, ia)) != want or b"".join(map(of_b, ib)) != want:
            ia = ib = []
        spans = []
        for ids, size in ((ia, of_a), (ib, of_b)):
            at, own = 0, []
            for i in ids:
                own.append((at, at + len(size(i)), i))
                at += len(size(i))
            spans.append(own)
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        inside = [defaultdict(list), defaultdict(list)]
        for side, own in zip(inside, spans):
            for _, e, i in own:
                side[bisect.bisect_left(cuts, e)].append(str(i))
        groups = [",".join(inside[0][k]) + "|" + ",".join(inside[1][k]) for k in range(len(cuts))]
        links, first = [], 0
        for s, e, i in spans[0]:
            while first < len(spans[1]) and spans[1][first][1] <= s:
                first += 1
            k = first
            while k < len(spans[1]) and spans[1][k][0] < e:
                links.append((i, spans[1][k][2]))
                k += 1
        counts.update(links)
        docs.append((doc_id, len(ia), len(ib), groups, links))
    most = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    out = []
    for doc_id, na, nb, groups, links in docs:
        best = sum(counts[x] == most[x[1]] for x in links)
        out.append((doc_id, na, nb, len(groups), len(links), best, sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    return out, counts, most


def found(df):
    return sorted(map(tuple, df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=repr)


def test_documents_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    want, _, _ = plain([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert found(alignment.op13_group_alignment(spark, data)) == sorted(want, key=repr)


def test_odd_texts(spark, monkeypatch):
    pick = random.Random(13)
    parts = ["foo", " ", "  ", "\n", "\t", " ", "é", "é", "ﬁ①", "日本語", "👩‍👩‍👧", "<s>", "<|endoftext|>", "<0x41>", "'s", "12345", "\x00", "!!", "—", "　", "straße", "x" * 40, "▁"]
    rows = [(k, "".join(pick.choices(parts[: -1 if k % 9 else None], k=pick.randint(1, 30)))) for k in range(500)]
    rows += [(None, "a row without an id"), (None, None), (7, None), (8, ""), (8, " "), (8, "   "), (9, "twice"), (9, "twice"), (1 << 62, "a large id"), (10, "▁ literal mark"), (11, "a " * 30000), (12, "b" * 20000)]
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 3000)
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, digest string, n_a int").repartition(3)
    documents, pairs = alignment.align(docs)
    want, counts, most = plain(rows)
    assert found(documents) == sorted(want, key=repr)
    assert {(r.a, r.b): (r["count"], r.best) for r in pairs.collect()} == {k: (n, n == most[k[1]]) for k, n in counts.items()}


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"))[0].count() == 0


def test_groups_by_documents(spark):
    docs = spark.createDataFrame([(1, "cat cat cat"), (2, "cat dog")], "doc_id long, text string")
    by_text, by_document = (alignment.align(docs, weight=w)[1].agg({"count": "max"}).first()[0] for w in ("n", "docs"))
    assert (by_text, by_document) == (4, 2)


@pytest.mark.parametrize("a, b, sizes_a, sizes_b, links", [([1], [2], [4], [4], [(1, 2)]), ([1, 3], [2, 4], [1, 3], [2, 2], [(1, 2), (3, 2), (3, 4)]), ([5], [6, 6, 6], [3], [1, 1, 1], [(5, 6)] * 3)])
def test_links_of_a_group(a, b, sizes_a, sizes_b, links):
    assert alignment.links_of(a, b, sizes_a, sizes_b) == links
    assert alignment.unpack_group(alignment.pack_group(*(b"".join(i.to_bytes(4, "little") for i in x) for x in (a, b)))) == (a, b)


def test_forgotten_memory_is_given_back():
    """A worker waits beside the JVM's later stages: it must not keep threads, nor what it knew of pieces."""
    code = """
import os, random
from gridlight.llm.alignment import Aligner, Pair
def now():
    return int(open("/proc/self/statm").read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6
pick, aligner = random.Random(1), Aligner.of(Pair.of())
aligner.align(["some text to begin with " * 9])
aligner.forget()
before, threads = now(), len(os.listdir("/proc/self/task"))
for _ in range(6):
    aligner.align([" ".join("".join(pick.choices(["th", "on", "er", "es", "ti"], k=9)) for _ in range(300)) for _ in range(100)])
held = now()
aligner.forget()
print(len(os.listdir("/proc/self/task")) - threads, held - before, now() - before)
"""
    env = {k: v for k, v in os.environ.items() if k != "TOKENIZERS_PARALLELISM"}
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, env=env | {"PYTHONPATH": os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))})
    threads, held, kept = map(float, said.stdout.split())
    assert threads == 0 and kept < 0.6 * held
