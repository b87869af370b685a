import itertools
import math
import random
import re
from collections import Counter

import pytest

from tidestock.llm import url_filter as uf

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule(host, path):
    fits = [(len(r), r, v) for r, v in RULES for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return max(fits)[1:] if fits else (None, None)


def runs(text):
    return ["#" if r[0].isdigit() else r for r in re.findall(r"[^\W\d_]+|\d+", text.lower())]


def cost(word, counts, total):
    known = [math.log(counts[word] / total)] if word in counts else []
    return max(known + [math.log(10 / total) - len(word) * math.log(10)])


def whole_job(pages):
    """Every split of every name is tried; tables are plain counters."""
    counts = Counter(w for _, _, html in pages for w in re.findall(r"[^\W\d_]+", re.sub(r"<[^>]*>", " ", html or "").lower()))
    total = max(1, sum(counts.values()))

    def split(name):
        if name == "#":
            return ["#"]
        options = []
        for cuts in itertools.product([0, 1], repeat=len(name) - 1):
            at = [0] + [i + 1 for i, c in enumerate(cuts) if c] + [len(name)]
            words = [name[a:b] for a, b in zip(at, at[1:])]
            options.append((sum(cost(w, counts, total) for w in words), words))
        return max(options)[1]

    rows, seen = [], {"block": Counter(), "allow": Counter()}
    pages_of = Counter()
    for v, seeds in uf.SEEDS.items():
        seen[v].update({w: uf.SEED_PAGES for w in seeds})
    for page_id, url, _ in pages:
        host, path = parts(url)
        r, v = rule(host, path)
        inner = host.rpartition(".")[0]
        words = [w for name in runs(inner) + runs(path) for w in split(name)]
        rows.append((page_id, host, path, r, v, words))
        if v:
            pages_of[v] += 1
            seen[v].update(words)
    size = len(seen["block"] | seen["allow"])
    sums = {v: sum(seen[v].values()) + size for v in seen}
    prior = math.log((pages_of["block"] + 1) / (pages_of["allow"] + 1))
    known = set(seen["block"]) | set(seen["allow"])
    out = []
    for page_id, host, path, r, v, words in rows:
        odds = prior + sum(math.log((seen["block"][w] + 1) / sums["block"]) - math.log((seen["allow"][w] + 1) / sums["allow"]) for w in words if w in known)
        out.append((page_id, host, path, r, v or ("block" if odds > 0 else "allow")))
    return out


def test_whole_job_against_all_splits(rows):
    rng = random.Random(2)
    words = ["news", "the", "wiki", "casino", "play", "red", "science", "bonus", "an", "a", "én"]
    pages = [(None, None, None), (1, "no scheme.net/x", "<p>"), (1, "http://", ""), (2, "HTTP://EXAMPLE.NET", "x"), (2, "HTTP://EXAMPLE.NET", "x"),
             (3, "a://b://c.net/en/?q", None), (4, "x://example.net:80/en/a#b", ""), (5, "x://notexample.com/de/", ""), (6, "x://www.example.com/de/x", ""),
             (7, "x://example.com/DE/x", ""), (8, "x://org/fr/", ""), (9, "x://net", ""), (10, "x://net/", ""), (11, "x://a.com/" + "/9" * 3000, "")]
    for k in range(200):
        name = lambda: "".join(rng.choices(words, k=rng.randrange(1, 4)))[:11]
        host = f"{name()}.{rng.choice(['example', name()])}.{rng.choice(['net', 'com', 'org', 'info'])}"
        url = f"http://{host}/{rng.choice(['en', 'de', 'fr', name()])}/{name()}{k}{rng.choice(['', '?a=b', '#t', '/'])}"
        pages.append((100 + k, url, f"<a href='{name()}'>{' '.join(rng.choices(words, k=9))}</a> Text é"))
    df = rows("page_id long, url string, html string, host string", *[(*p, "x") for p in pages])
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in uf.judge(df, RULES).collect()), key=str)
    assert got == sorted(whole_job(pages), key=str)
    assert len({(r, v) for *_, r, v in got}) >= 6
    assert uf.judge(df.limit(0), RULES).count() == 0


def test_segmentation_finds_the_words():
    counts = {"new": 50, "news": 90, "paper": 70, "newspaper": 1, "s": 3, "daily": 40}
    def known(name):
        return [(i, k, counts[name[i : i + k]]) for i in range(len(name)) for k in range(1, 21) if name[i : i + k] in counts and i + k <= len(name)]
    assert uf.segment("dailynewspaper", known("dailynewspaper"), 100_000) == ["daily", "newspaper"]
    assert uf.segment("newsdaily", known("newsdaily"), 100_000) == ["news", "daily"]
    assert uf.segment("qqqq", [], 100_000) == ["qqqq"]
    assert "".join(uf.segment("x" * 500, [], 100)) == "x" * 500


def test_untold_urls_follow_the_fixed_words(rows):
    df = rows("page_id long, url string, html string", (1, "http://www.freecasino.com/poker", "free casino poker"), (2, "http://openwiki.org/science", "open wiki science"))
    assert {r.page_id: r.verdict for r in uf.judge(df, ()).collect()} == {1: "block", 2: "allow"}


def test_words_of_any_length(rows):
    """A compound of 34 letters is one word if the pages use it, whole or inside a longer name."""
    long, longer = "rechtsschutzversicherungsgesetzbuch", "rechtsschutzversicherungsgesetzbuchhandlung"
    html = f"<p>{long} {long} die der das haus {longer} garten</p>" * 3
    counts = uf.word_counts(uf.F.col("html"), rows("html string", (html,)))
    assert {r.word: r["count"] for r in counts.where("length(word) > 20").collect()} == {long: 6, longer: 3}
    names = [long, longer, f"das{long}haus", f"{long}xq", "haus" * 9, "q" * 50, "garten" + "zz" * 400]
    got = {r.name: r.words for r in uf.segmented(rows("name string", *[(n,) for n in names]), counts).collect()}
    assert got[long] == [long] and got[longer] == [longer] and got[f"das{long}haus"] == ["das", long, "haus"]
    assert got[f"{long}xq"] == [long, "xq"] and got["haus" * 9] == ["haus"] * 9 and got["q" * 50] == ["q" * 50]
    assert got["garten" + "zz" * 400] == ["garten", "zz" * 400]


def test_segmentation_of_unknown_pieces():
    """Against every split, with unknown pieces of any length."""
    rng = random.Random(4)
    counts = {"ab": 50, "abc": 7, "c": 3, "bca": 900}
    for _ in range(200):
        name = "".join(rng.choices("abcd", k=rng.randrange(1, 11)))
        found = [(i, len(w), n) for w, n in counts.items() for i in range(len(name)) if name.startswith(w, i)]
        best = max(
            sum(cost(name[a:b], counts, 1000) for a, b in zip(at, at[1:]))
            for cuts in itertools.product([0, 1], repeat=len(name) - 1)
            for at in [[0] + [i + 1 for i, c in enumerate(cuts) if c] + [len(name)]]
        )
        assert sum(cost(w, counts, 1000) for w in uf.segment(name, found, 1000)) == pytest.approx(best)
