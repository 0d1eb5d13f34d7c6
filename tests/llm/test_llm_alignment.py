"""Tokenizer alignment against plain Python."""

import collections
import hashlib
import random

import pytest

from tidewatch.llm import alignment, queries


@pytest.fixture(scope="module")
def tokens():
    """Text to [(id, bytes)] of either vocabulary, by the vocabulary files themselves."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    # the byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(c): c for c in keep} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in keep)}
    names = {i: bytes(back[c] for c in t) for t, i in a.get_vocab(with_added_tokens=False).items() if all(c in back for c in t)}

    def both(text):
        left = [(i, names[i]) for i in a.encode(" " + text, add_special_tokens=False).ids]
        right = [(i, bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode())
                 for i, p in ((i, b.id_to_piece(i)) for i in b.encode(text))]
        return left, right

    return both


def plain(rows, tokens):
    """Per row: the contract's values by walking over bytes."""
    part, held = [], collections.Counter()
    for doc, text in rows:
        left, right = tokens(text) if text else ([], [])
        whole = (" " + (text or "")).encode()
        if not text or b"".join(x for _, x in left) != whole or b"".join(x for _, x in right) != whole:
            left, right = [], []
        ends, links, groups = [], [], []
        for side in (left, right):
            at, out = 0, []
            for _, x in side:
                out.append((at, at + len(x)))
                at += len(x)
            ends.append(out)
        i = j = 0
        while i < len(left):
            a, b = [left[i][0]], [right[j][0]]
            while ends[0][i][1] != ends[1][j][1]:
                if ends[0][i][1] < ends[1][j][1]:
                    i += 1
                    a.append(left[i][0])
                else:
                    j += 1
                    b.append(right[j][0])
            groups.append((a, b))
            i, j = i + 1, j + 1
        for (s, e), (a, _) in zip(ends[0], left):
            links += [(a, b) for (p, q), (b, _) in zip(ends[1], right) if p < e and s < q] if len(right) < 400 else []
        if len(right) >= 400:
            links, j = [], 0
            for (s, e), (a, _) in zip(ends[0], left):
                while ends[1][j][1] <= s:
                    j += 1
                k = j
                while k < len(right) and ends[1][k][0] < e:
                    links.append((a, right[k][0]))
                    k += 1
        held.update(set(links))
        text_of = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        part.append((doc, len(left), len(right), len(groups), links, hashlib.sha256(text_of.encode()).hexdigest() if groups else ""))
    most = {}
    for (a, _), n in held.items():
        most[a] = max(n, most.get(a, 0))
    return sorted((doc, na, nb, ng, len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), digest)
                  for doc, na, nb, ng, links, digest in part)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = ["", None, " ", "  two  spaces", "a<|endoftext|>b", "<s>x</s><unk>", "tab\tnew\nline\r\n", "▁mark", "naïve — 中文 \U0001F600",
       "<0x41>", "é combining", " nbsp", "\x00\x01", "trailing ", "word " * 3000]


def odd_rows():
    rng = random.Random(6)
    made = ["".join(rng.choice("ab é中\n<|>\U0001F600_1.") for _ in range(rng.randrange(0, 60))) for _ in range(60)]
    return list(enumerate(ODD + made + made[:5]))


@pytest.mark.parametrize("broadcast_rows", [2_000_000, 0])
def test_linked_documents_match_plain(spark, tokens, broadcast_rows):
    rows = odd_rows()
    df = spark.createDataFrame([(i, t, 1, "x", [2]) for i, t in rows], "doc_id long, text string, n int, a string, times array<int>").repartition(4)
    got = alignment.linked_documents(df, broadcast_rows=broadcast_rows)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == plain(rows, tokens)


def test_repeated_rows_null_ids_and_nothing(spark):
    df = spark.createDataFrame([(None, "same words"), (None, "same words"), (3, "same words")], "doc_id long, text string")
    rows = alignment.linked_documents(df).collect()
    assert len(rows) == 3 and {tuple(r)[1:] for r in rows} == {tuple(rows[0])[1:]}
    assert rows[0].count_sum == 3 * rows[0].n_links
    assert alignment.linked_documents(df.where("false")).count() == 0


def test_groups_cover_the_text(spark, tokens):
    rows = odd_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = collections.defaultdict(list)
    for r in alignment.groups(df).collect():
        found[r.doc_id].append((r.place, r.bytes, list(r.a), list(r.b)))
    for doc, text in rows:
        got = sorted(found.get(doc, []))
        if got:
            left, right = tokens(text)
            assert [i for g in got for i in g[2]] == [i for i, _ in left] and [i for g in got for i in g[3]] == [i for i, _ in right]
            assert sum(g[1] for g in got) == len((" " + text).encode())


def test_query_matches_plain(spark, sf_dir, tokens):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    df = queries.op12_tokenizer_alignment(spark, sf_dir)
    assert df.columns == COLUMNS
    assert sorted(map(tuple, df.collect())) == plain(docs, tokens)
