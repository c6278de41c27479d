"""Main text: regions, names as evidence, quotes, and a plain tag-path scorer on random pages."""

from __future__ import annotations

import random
import statistics
from html.parser import HTMLParser

import pytest
from scarp.llm import webtext

BODY = [f"Sentence {k} of the body, which is long enough to count; it goes on, and it ends here." for k in range(12)]
INSIDE = "".join(f"<p>{x}</p>" for x in BODY)


def kept(source):
    return webtext.content(webtext.Page(source), 0.5)


@pytest.mark.parametrize("paragraphs", [3, 6, 12])
def test_what_an_article_holds_stays(paragraphs):
    inside = "".join(f"<p>{x}</p>" for x in BODY[:paragraphs])
    page = f"""<nav><ul><li><a href=/>Home</a></ul></nav><article><h1>A title</h1>{inside}<ul><li>one</li><li>two items</li></ul>
    <table><tr><td>a</td><td>17</td></tr></table><pre>x = 1</pre><figure><img src=x><figcaption>A caption</figcaption></figure><h2>Part</h2></article><footer>foot</footer>"""
    assert kept(page) == ["A title", *BODY[:paragraphs], "one", "two items", "a", "17", "x = 1", "A caption", "Part"]


def test_what_a_plain_container_holds_stays():
    page = f"<body><div class=top><a href=/>Home</a></div><h1>A title</h1><div id=text>{INSIDE}<ul><li>one</li></ul><pre>x = 1</pre></div><div><a href=/n>Next</a> <a href=/p>Back</a></div></body>"
    assert kept(page) == ["A title", *BODY, "one", "x = 1"]


@pytest.mark.parametrize("name", ["share-price-report", "flood-alert-history", "search-engines", "comment-free", "no-sidebar", "social_history"])
def test_one_word_of_a_name_does_not_decide(name):
    for page in (f"<div class='{name}'><h1>T</h1>{INSIDE}</div>", f"<div id='{name}'><article><h1>T</h1>{INSIDE}</article></div>", f"<article><h1>T</h1>{INSIDE}<section id='{name}'><h2>Part</h2><p>{BODY[0]}</p></section></article>"):
        text = kept(page)
        assert text[: 1 + len(BODY)] == ["T", *BODY]
        assert text[1 + len(BODY) :] in ([], ["Part", BODY[0]]) and ("section" in page) == (len(text) > 1 + len(BODY))


@pytest.mark.parametrize("name", ["sidebar", "ad", "post-comments", "related-posts", "comment-list", "cookie-notice", "nav-links", "share-buttons", "footer-inner"])
def test_a_name_that_is_noise_does(name):
    noise = f"<div class='{name}'><p>{BODY[0]}</p></div>"
    for page in (f"<body><div>{INSIDE}</div>{noise}</body>", f"<article>{INSIDE}{noise}</article>", f"<main>{noise}{INSIDE}</main>"):
        assert kept(page) == BODY


def test_quotes_open_values_only_after_an_equals_sign():
    assert kept(f"<article><p data-x=don't>{BODY[0]}</p><p it's>{BODY[1]}</p><p title = 'a>b' x=\"c>d\">{BODY[2]}</p></article>") == BODY[:3]
    assert kept(f"<article>{INSIDE}<p title='never closed>x</article>") == BODY
    assert len(webtext.Page("<p a=" * 20_000 + "<p ='" * 20_000).blocks) == 0


class Tree(HTMLParser):
    """Leaves of a well-formed page: (path of (tag, names), words against, in an article, text, in links)."""

    def __init__(self):
        super().__init__()
        self.stack, self.leaves = [], []

    def handle_starttag(self, tag, attrs):
        self.stack.append((tag, dict(attrs).get("class", "")))

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        path = tuple(x for x in self.stack if x[0] != "a")
        self.leaves.append((path, data, any(x[0] == "a" for x in self.stack)))


def plain(source, threshold=0.5):
    """The same rules over whole lists; class names are ad (noise), ad-history (a hint) or none."""
    tree = Tree()
    tree.feed(source)
    leaves = [x for x in tree.leaves if not any(t in ("nav", "footer") for t, _ in x[0])]
    if not leaves:
        return []
    paths = list(dict.fromkeys(p for p, _, _ in leaves))

    def of(p):
        own = [(t, link) for q, t, link in leaves if q == p]
        names = [c for _, c in p]
        against = 0.05 if "ad" in names else 0.5 if "ad-history" in names else 1.0
        return {"length": sum(len(t) for t, _ in own), "points": sum(t.count(".") + t.count(",") for t, _ in own), "n": len(own), "linked": sum(len(t) for t, link in own if link), "against": against, "article": any(t == "article" for t, _ in p)}

    facts = [of(p) for p in paths]
    fair = [0 if f["against"] == 0.05 else f["length"] - f["linked"] for f in facts]
    share = sum(x for x, f in zip(fair, facts) if f["article"]) / max(sum(fair), 1)
    for f in facts:
        f["prior"] = 1 + share if f["article"] else 1
        f["links"] = f["linked"] / f["prior"]
        lent = 0.05 if f["against"] == 0.05 else 1
        f["t"], f["p"] = lent * (f["length"] - f["links"]) / f["n"], lent * f["points"] / f["n"]

    def smooth(k, key):
        return 0.25 * facts[max(k - 1, 0)][key] + 0.5 * facts[k][key] + 0.25 * facts[min(k + 1, len(facts) - 1)][key]

    fused = [smooth(k, "t") * (1 + smooth(k, "p")) * (1 - f["links"] / max(f["length"], 1)) * f["against"] for k, f in enumerate(facts)]
    bar = threshold * statistics.pstdev(fused)
    chosen = {p for p, f, x in zip(paths, facts, fused) if f["prior"] * x >= bar and (f["linked"] <= 0.5 * f["length"] or f["article"] and share >= 0.5)}
    known = dict(zip(paths, facts))
    total = sum(known[p]["length"] for p in chosen)
    tops = {p[:k] for p in chosen for k in range(len(p))}
    top = max((t for t in tops if sum(known[p]["length"] for p in chosen if p[: len(t)] == t and len(p) > len(t)) >= 0.8 * total), key=len, default=None)
    picked = [k for k, (p, _, _) in enumerate(leaves) if p in chosen]
    out = []
    for k, (p, text, _) in enumerate(leaves):
        f = known[p]
        near = top is not None and (f["article"] and share >= 0.5 or p[: len(top)] == top and (top[-1:] not in ((), (("body", ""),)) or picked[0] <= k <= picked[-1]))
        for d in range(1, len(p) + 1):
            if p[d - 1][1] == "ad-history" and not any(q[:d] == p[:d] for q in chosen):
                near = False
        if p in chosen or near and f["linked"] <= 0.5 * f["length"] and f["against"] > 0.05:
            out.append(text)
    return out


def random_page(rng):
    def element(depth):
        name = rng.choice(["", "", "", " class=ad", " class=ad-history"])
        if depth == 0 or rng.random() < 0.45:
            tag = rng.choice(["p", "li", "td", "pre"])
            text = "".join(rng.choice(["word ", "more words, ", "an end. "]) for _ in range(rng.choice([1, 2, 12, 30]))).strip()
            return f"<{tag}>" + (f"<a href=x>{text}</a>" if rng.random() < 0.2 else text) + f"</{tag}>"
        tag = rng.choice(["div", "section", "div", "article", "nav"]) if depth > 1 else "div"
        return f"<{tag}{name}>" + "".join(element(depth - 1) for _ in range(rng.randint(1, 5))) + f"</{tag}>"

    return "<body>" + "".join(element(3) for _ in range(rng.randint(1, 4))) + "</body>"


def test_against_a_plain_scorer():
    rng, some = random.Random(21), 0
    for _ in range(400):
        page = random_page(rng)
        # An outermost article takes no names from around it; the plain version leaves such pages out.
        if "<article" in page and "class=ad" in page:
            continue
        assert kept(page) == plain(page), page
        some += 0 < len(kept(page)) < page.count("<p>") + page.count("<li>") + page.count("<td>") + page.count("<pre>")
    assert some > 60
