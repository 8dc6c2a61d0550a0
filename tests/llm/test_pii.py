import math
import random
import re

from pyspark.sql import functions as F

from frameloom.llm import pii

#: The plain forms of the contract.
PLAIN = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(number):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(number)))) % 10 == 0


def base(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_base_spans_equal_the_plain_forms(spark, odd):
    rng = random.Random(1)
    parts = ["a", "b.c", "@", ".", "-", "_", "1", "22", "255", "256", " ", "+", "(", ")", "4111111111111111", "4111 1111 1111 1111", "+1 (555) 010-9999", "x@y.z", "10.0.0.1", "é", "\n", "日"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(3000)]
    texts += ["1" * 30000, "a" * 30000 + "@b.c", "1 " * 20000, "10.0.0.1 " * 2000, "😀 x@y.z", "0010.0.0.001"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    rows = pii.base_spans(docs).select("text", pii.listed(F.col("base")).alias("spans")).collect()
    assert [(r.text[:99], r.spans) for r in rows if r.spans != base(r.text)] == []


def entities_of(kind, value):
    number = re.sub("[^0-9]", "", value)
    exact = f"{kind}:{number if kind in ('card', 'phone') else value.lower()}"
    wide = {"email": value.lower().partition("@")[2], "ip": ".".join(value.split(".")[:2]), "card": number[:6], "phone": number[:4]}[kind]
    user = re.sub("[^a-z]", "", value.lower().partition("@")[0]) if kind == "email" else ""
    return exact, f"in {kind}:{wide}", *([f"user:{user}"] if len(user) >= 3 else []), wide


def plain_result(texts, threshold=0.6):
    """Of each text its term spans and sanitised form, by counting over documents, from the formulas."""
    holds = [{m[0].lower() for m in re.finditer(r"[^\W\d_]{3,}", t)} for t in texts]
    spans = [[(int(x.split(":")[1]), int(x.split(":")[2]), x.split(":")[0]) for x in base(t).split(",") if x] for t in texts]
    owner = {}
    for i, t in enumerate(texts):
        for a, b, kind in spans[i]:
            for e in entities_of(kind, t[a:b])[:-1]:
                owner.setdefault(e, set()).add(i)
    n, told = len(texts), {}
    for e, docs in owner.items():
        for term in set().union(*(holds[i] for i in docs)):
            both = [i for i in docs if term in holds[i]]
            k = len({texts[i] for i in both})
            if len(docs) < n and k > 1:
                share = math.log2(n * len(both) / (sum(term in h for h in holds) * len(docs))) / math.log2(n / len(docs)) * k / (k + 1)
                if round(share, 9) >= threshold:
                    told.setdefault(e, set()).add(term)
    out = []
    for i, t in enumerate(texts):
        terms = set().union(*(told.get(e, set()) for e, docs in owner.items() if i in docs), set())
        extra = [(m.start(), m.end(), "term") for m in re.finditer(r"[^\W\d_]{3,}", t) if m[0].lower() in terms]
        extra = [x for x in extra if not any(x[0] < b and a < x[1] for a, b, _ in spans[i])]
        clean, done = "", 0
        for a, b, kind in sorted(spans[i] + extra, key=lambda x: (x[0], pii.KINDS.index(x[2]), x[1])):
            label = f"[{kind.upper()}]"
            if kind != "term":
                exact, wide, *_, name = entities_of(kind, t[a:b])
                if len(owner[exact]) < n and round(math.log2(n / len(owner[wide])) / math.log2(n / len(owner[exact])), 9) < threshold:
                    label = f"[{kind.upper()} {name}]"
            clean += "" if a < done else t[done:a] + label
            done = max(done, b)
        out.append(([(a, b) for a, b, _ in extra], clean + t[done:]))
    return out


def told_texts():
    rng = random.Random(2)
    texts = []
    for i in range(200):
        who = rng.randrange(8)
        words = [f"word{'abcdefghij'[rng.randrange(10)]}" for _ in range(12)]
        if i % 3:
            at = rng.randrange(12)
            words[at:at] = [f"nick{'abcdefgh'[who]}", rng.choice(["writes", "from", "says"]), f"user{who}@mail.org"]
        texts.append(" ".join(words))
    return texts + texts[:20]


def test_sql_equals_the_query(spark, tmp_path):
    import duckdb

    from frameloom.llm.oracles import PERSONAL
    from frameloom.llm.queries import op9_personal_data

    docs = [*enumerate([*told_texts(), "ende: é@x.y", "x@y.zz", "00012.3.4.0005 +49 (30) 1234567-8", "\n+1 555 010 9999\n", "card 4111 1111-1111 1111, no 4111 1111 1111 1112", ""])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    found = op9_personal_data(spark, str(tmp_path))
    got, want = sorted(map(tuple, found.collect())), sorted(con.execute(PERSONAL).fetchall())
    assert found.columns == [x[0] for x in con.description] and got == want and any("term" in r[-2] for r in got)


def test_terms_and_labels_equal_plain_counting(spark):
    texts = [*told_texts(), *(f"host {i} at 10.{i % 3}.0.{i} rackname{'abc'[i % 3]}" for i in range(30)), *(f"call +1 (555) 010 {1000 + i} now" for i in range(9)), "+49 (30) 1234567-8x@y.zz card 4111 1111-1111 1111", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.sanitised(pii.personal_data(docs)).collect()}
    assert len(rows) == len(texts)
    want = plain_result(texts)
    for i, (spans, clean) in enumerate(want):
        assert (sorted((s.start, s.end) for s in rows[i].spans if s.kind == "term"), rows[i].clean_text) == (spans, clean)
    cleaned = [x for _, x in want]
    assert any("[TERM]" in x for x in cleaned) and any("[IP 10." in x for x in cleaned) and any("[EMAIL mail.org]" in x for x in cleaned) and any("[PHONE" in x for x in cleaned)


def test_a_copy_is_one_text(spark):
    texts = ["rare word of x@y.zz"] * 5 + [f"other text {i}" for i in range(20)]
    rows = pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert not any(s.kind == "term" for r in rows for s in r.spans)


def test_odd_tables(odd, none):
    found = pii.personal_data(odd.withColumn("spans", odd.n_chars))
    assert found.count() == odd.count() and pii.personal_data(none).count() == 0
    assert not re.search("Python|Pandas|Arrow", found._jdf.queryExecution().executedPlan().toString())
