from __future__ import annotations

import random

import duckdb
import pytest

LANGS = {"en": "the of and ing tion er on th", "de": "der ein ung schaft ich keit ver", "fr": "le eau tion ou que ment re é"}


def words(r: random.Random, n: int, lang: str = "en") -> str:
    parts = LANGS[lang].split()
    return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(n))


def corpus(seed: int = 5, n: int = 120) -> list[tuple]:
    """Documents with repeated lines, exact and near copies, nulls and empty texts, and one long text."""
    r = random.Random(seed)
    common = [words(r, 6) + f" common {k}" for k in range(4)]
    out = []
    for i in range(n):
        lines = [words(r, r.randint(3, 25), r.choice(list(LANGS))) for _ in range(r.randint(1, 5))]
        if r.random() < 0.5:
            lines.insert(r.randint(0, len(lines)), r.choice(["  ", ""]) + (c.upper() if (c := r.choice(common)) and r.random() < 0.3 else c) + r.choice(["\t", "", " \r"]))
        out.append("\n".join(lines))
    for i in range(0, n, 6):
        out[i] = out[i // 2]
    for i in range(3, n, 9):
        w = (out[i // 3] or "x").split(" ")
        w[r.randrange(len(w))] = "changed"
        out[i] = " ".join(w)
    out[7], out[8], out[9], out[10] = None, "", "one", " \n\t"
    out[11] = words(r, 4000)
    return [(k, t, "en", f"src{k % 3}", None if t is None else len(t)) for k, t in enumerate(out)]


@pytest.fixture(scope="session")
def folder(spark, tmp_path_factory):
    """Small tables in the driver's layout."""
    at = tmp_path_factory.mktemp("tables")
    docs = corpus()
    r = random.Random(9)
    passages = [" ".join(docs[i][1].split()[:14]) for i in (20, 30, 40)]
    put = lambda rows, schema, name: spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{at}/{name}.parquet")
    put(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint", "documents")
    put([(i, p.upper() if i else p) for i, p in enumerate(passages)] + [(3, docs[25][1].split()[0]), (4, ""), (5, None), (6, words(r, 30))], "item_id bigint, text string", "benchmark")
    put([(k, int(k % 3 > 0), int(k % 4 == 0)) for k in range(0, 100, 2)], "doc_id bigint, quality int, toxic int", "labels")
    urls = ["http://a.example.org/es/1", "https://example.org/en/12?x#y", "HTTP://X.EXAMPLE.ORG", "https://x.com/fr/", "https://x.com/de/q#?", "x.com/fr/", None, "", "http://notorg/", "ftp://org/", "http://a.org:80/es/", "http://com/de/#://org/"]
    put([(k, u, "<p>") for k, u in enumerate(urls)] + [(0, urls[0], "<p>"), (None, urls[1], None)], "page_id bigint, url string, html string", "pages")
    talk = [(c, t, ("user", "assistant")[t % 2], r.choice(["hello", "a<|im_end|>b", "\\n \\ <|", "", None, "line\nline"])) for c in range(6) for t in range(r.randint(1, 6))]
    put(talk + [(9, 0, None, "x"), (9, None, "sys\ntem", "y")], "conv_id bigint, turn bigint, role string, text string", "conversations")
    vector = lambda k: [r.gauss(0, 0.3) for _ in range(16)]
    put([(k * 3, None if k == 4 else [None, *vector(k)[1:]] if k == 5 else [float("nan"), *vector(k)[1:]] if k == 6 else vector(k), k % 5 or None) for k in range(80)], "vec_id bigint, embedding array<float>, label int", "embeddings")
    return str(at)


@pytest.fixture(scope="session")
def oracle(folder):
    con = duckdb.connect()
    for name in ("documents", "benchmark", "labels", "pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")

    def run(sql: str) -> list[tuple]:
        found = con.execute(f"SELECT * FROM ({sql})")
        names = [d[0] for d in found.description]
        return sorted((tuple(v for _, v in sorted(zip(names, row, strict=True))) for row in found.fetchall()), key=repr)

    return run


@pytest.fixture(scope="session")
def rows():
    def take(df) -> list[tuple]:
        return sorted((tuple(v for _, v in sorted(r.asDict().items())) for r in df.collect()), key=repr)

    return take
