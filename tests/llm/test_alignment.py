"""Token alignment against a plain reading of its definition, and its edge cases."""

import collections
import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from gridloom.llm import token_alignment

COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def brute_force(rows):
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    alphabet = token_alignment.byte_alphabet()

    def bytes_a(i):
        return bytes(alphabet[c] for c in a.id_to_token(i))

    def bytes_b(i):
        return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    found = []
    for doc, text in rows:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        whole = (" " + (text or "")).encode()
        if b"".join(map(bytes_a, ids_a)) != whole or b"".join(map(bytes_b, ids_b)) != whole:
            found.append((doc, [], [], []))
            continue

        def ends(ids, of):
            at, out = 0, {}
            for i in ids:
                at += len(of(i))
                out[at] = i
            return out

        end_a, end_b = ends(ids_a, bytes_a), ends(ids_b, bytes_b)
        shared, last, groups = sorted(end_a.keys() & end_b.keys()), 0, []
        for e in shared:
            groups.append("|".join(",".join(str(i) for at, i in side.items() if last < at <= e) for side in (end_a, end_b)))
            last = e
        found.append((doc, ids_a, ids_b, [(g, end_a[e], end_b[e]) for g, e in zip(groups, shared, strict=True)]))
    counts = collections.Counter((x, y) for *_, groups in found for _, x, y in groups)
    best = collections.defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    for doc, ids_a, ids_b, groups in found:
        own = [counts[x, y] for _, x, y in groups]
        digest = hashlib.sha256(";".join(g for g, *_ in groups).encode()).hexdigest() if groups else ""
        yield doc, len(ids_a), len(ids_b), len(groups), len(groups), sum(n == best[y] for n, (_, _, y) in zip(own, groups, strict=True)), sum(own), digest


def fixture():
    texts = [None, "", " ", "\n\n", "a", "naïve café 中文 \U0001f600\U0001f44d", "a▁b", "<s> x </s><unk> <|endoftext|> <0x41>", "  two  spaces ", "x\0y", "tab\tand wide　", "12345 67", "don't we'll"]
    texts += ["the cat sat on the mat; the dog did not. " * k for k in (1, 3, 40)] + ["y" * 5000, " " * 3000 + "end", "Straße übergroß " * 30]
    rng = random.Random(3)
    texts += [" ".join("".join(rng.choice("aeionrst") for _ in range(rng.randrange(1, 9))) for _ in range(60)) for _ in range(6)]
    return [(i, t) for i, t in enumerate(texts)] + [(5, "repeated id"), (None, "no id"), (3, "\n\n")]


def result(docs, **options):
    return sorted((tuple(r[c] for c in COLUMNS) for r in token_alignment.align_tokenizers(docs, **options).collect()), key=repr)


def test_equals_brute_force(spark):
    rows = fixture()
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, links string, row long, n long")
    expected = sorted(brute_force(rows), key=repr)
    assert any(e[5] < e[3] for e in expected)
    assert result(docs) == expected
    for most in (0, 5, 60):  # rare pairs through the join
        assert result(docs.repartition(3), most_pairs=most) == expected


def test_query_equals_brute_force(spark):
    got = token_alignment.op12_token_alignment(spark, "/root/testdata/sf0.001")
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got.collect()) == sorted(brute_force(rows))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert result(docs) == [] and token_alignment.align_tokenizers(docs).columns == list(COLUMNS)


def test_slices_of_long_texts(monkeypatch):
    a, b = token_alignment.side(token_alignment.default_vocabulary()), token_alignment.side(token_alignment.piece_vocabulary())
    texts = ["a▁b", "one two three " * 50, None, "x" * 700]
    whole = token_alignment.align(texts, a, b)
    monkeypatch.setattr(token_alignment, "SLICE", 64)
    again = token_alignment.align(texts, a, b)
    assert whole[1] == again[1] and all((whole[0][k] == again[0][k]).all() for k in whole[0]) and (whole[2] == again[2]).all()


@pytest.mark.parametrize("text", [" " * 150_000, "a" + " " * 1_200_000 + "b <|endoftext|>", ("x" + " " * 99_998) * 12])
def test_long_blanks(text):
    a = token_alignment.side(token_alignment.default_vocabulary())
    library = Tokenizer.from_file(token_alignment.default_vocabulary())
    library.encode_special_tokens = True
    assert a.encode([text])[0] == library.encode(" " + text, add_special_tokens=False).ids
