"""Text operators do the whole job, also where the given tables don't show it."""

import random
import string

from feltloom.llm import html, language, secrets

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def test_more_languages_than_bits_of_a_word(spark):
    rng = random.Random(7)
    letters = [chr(0x4E00 + i) for i in range(140 * 6)]
    own = {f"l{i:03}": letters[6 * i : 6 * i + 6] for i in range(140)}
    texts = [(lang, " ".join("".join(rng.choices(own[lang], k=4)) for _ in range(12))) for lang in own for _ in range(5)]
    rows = spark.createDataFrame([(i, t, lang, "s", len(t)) for i, (lang, t) in enumerate(texts)], DOC)
    model = language.train(rows)
    assert model.langs == sorted(own) and model.masks.shape[1] == 3
    got = {r.doc_id: r.lang_pred for r in language.identified(rows, model).collect()}
    assert got == {i: lang for i, (lang, _) in enumerate(texts)}


def test_keys_beside_other_characters(spark):
    rng = random.Random(4)
    key = lambda letters, n=40: "".join(rng.choice(letters) for _ in range(n))
    plain, url = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "-_"
    keys = [key(plain), key(url), key(plain + "+/"), key(plain), key(url), key(string.ascii_lowercase, 150), key(plain)]
    texts = [f"auth={keys[0]} x", f"sig={keys[1]}", f"AWS_ACCESS_KEY={keys[2]}", f"my-host/path/{keys[3]}", f"my-host/path+{keys[4]}", keys[5], f"{keys[6]}=="]
    texts += ["-" * 80, "=" * 80, "a-very-long-hyphenated-name-that-is-just-words", "donaudampfschifffahrtsgesellschaftskapitaen", "one/way-or_another/of+writing-words_in-a/row"]
    rows = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOC)
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secrets.confirmed(secrets.scanned(rows)).collect()}
    clean = {r.doc_id: r.text for r in secrets.redacted(rows).collect()}
    for i, k in enumerate(keys):
        assert k not in clean[i] and "[SECRET]" in clean[i]
        assert any(kind == "random" and start <= texts[i].index(k) and texts[i].index(k) + len(k) <= end for kind, start, end in found[i]), texts[i]
    assert clean[0] == "auth=[SECRET] x" and clean[2] == "AWS_ACCESS_KEY=[SECRET]"
    for i in range(len(keys), len(texts)):
        assert found[i] == [] and clean[i] == texts[i]


def test_links_inside_an_article():
    article = "<nav><a href=/>Home</a></nav><article>{}</article><p>After</p>"
    kept = {
        "<p>See <a href=r>the report</a> for more.</p>": "See the report for more.",
        "<ul><li>One item with <a href=x>a link</a><li>Two</ul>": "One item with a link Two",
        "<h2><a href=t>Linked title</a></h2><h3><a id=s></a>Anchored</h3><p>Text</p>": "Linked title Anchored Text",
        "<p><a name=top>First</p><p>Second</p>": "First Second",
        "<p>See what is <a href=x>open</p><p>Second</p>": "See what is open Second",
        "<ul><li>An item with <a href=x>one<li>Two</ul><p>Third</p>": "An item with one Two Third",
        "<p>Text</p><p><a href=a>One</a> <a href=b>Two</a></p>": "Text",
    }
    for source, text in kept.items():
        assert html.main_text(article.format(source)) == text, source


def test_discoveries_among_structured_tokens(spark):
    """Planted keys of 20 to 64 characters beside joined words, counters and runs of letters: what share of discoveries is false, and what is found."""
    rng = random.Random(11)
    sound = lambda: "".join(rng.choice(x) for x in ["bcdfglmnprst", "aeiou", "bdlmnrst", "aeiou"])
    names = [
        lambda n: "".join(sound().title() for _ in range(n // 4)), lambda n: "_".join(sound() for _ in range(n // 5 + 1)), lambda n: "-".join(sound() + str(rng.randrange(9)) for _ in range(n // 6 + 1)),
        lambda n: "".join(sound() for _ in range(n // 4)), lambda n: f"{rng.randrange(10**6):0{n}d}", lambda n: (string.ascii_letters * 3)[rng.randrange(20) :][:n], lambda n: "/".join(sound() for _ in range(n // 5 + 1)),
    ]
    letters = [string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "-_", string.ascii_lowercase + string.digits]
    keys = ["".join(rng.choice(letters[i % 3]) for _ in range(rng.randrange(20, 65))) for i in range(300)]
    plain = [names[i % len(names)](rng.randrange(20, 65)) for i in range(1400)]
    rows = spark.createDataFrame([(i, f"see {t} there", "en", "s", 0) for i, t in enumerate(keys + plain)], DOC)
    hit = {r.doc_id for r in secrets.confirmed(secrets.scanned(rows)).collect() if any(s.kind == "random" for s in r.spans)}
    false = sum(i >= len(keys) for i in hit)
    print("discoveries", len(hit), "false", false, "of keys", sum(i in hit for i in range(len(keys))))
    assert false <= 0.05 * len(hit)
    assert sum(i in hit for i in range(len(keys)) if len(keys[i]) >= 32) >= 0.85 * sum(len(k) >= 32 for k in keys)
    assert sum(i in hit for i in range(len(keys))) >= 0.7 * len(keys)
