"""Repaired bodies against the rules applied to one page at a time in Python."""

import random
import re

from kelpie.operators import ingest, repair

BARE = re.compile(r"^\s*(?:[-*+]|\d+\.)?\s*(?:\"\"|''|\u201c\u201d|\u2018\u2019)?\s*$")


def stem(target):
    name = target.rstrip("/").split("/")[-1]
    return re.sub(r"(?<=[^.])\.[^.]*$", "", name)


def by_hand(body, edits):
    for t, action, new in sorted(edits, key=lambda e: (repair.ACTIONS.index(e[1]), e[0])):
        at = re.escape(t)
        wiki = re.compile(r"(?<!!)\[\[" + at + r"(#[^|\\\]]*)?(?:\\?(\|[^\]\n]*))?\]\]")
        if action == "fix":
            body = re.sub(r"(?<!!)\[\[" + at + r"(?=[\]|#\n])", lambda m: "[[" + new, body)
        elif action == "relink":
            body = re.sub(r"(?<!!)\[([^\]]*)\]\(" + at + r"(?:#[^)]*)?\)", lambda m: f"[{m[1]}]({new})", body)
        elif action == "mark":
            body = wiki.sub(lambda m: f"[[{t}{m[1] or ''}|(broken link) {m[2][1:] if m[2] else t}]]", body)
        elif action == "break":
            body = wiki.sub(lambda m: f"[[broken-link|{m[2][1:] if m[2] else t}]]", body)
        elif action == "delink":
            body = re.sub(r"(?<!!)\[\[" + at + r"(?:#[^|\\\]]*)?(?:\\?\|([^\]]*))?\]\]", lambda m: m[1] if m[1] is not None else stem(t), body)
        else:
            link = r"(?<!!)\[\[" + at + r"(?:#[^|\\\]]*)?(?:\\?\|[^\]]*)?\]\]" if action == "delete" else r"(?<!!)\[[^\]]*\]\(" + at + r"(?:#[^)]*)?\)"
            out = []
            for line in body.splitlines(keepends=True):
                if not re.search(link, line):
                    out.append(line)
                    continue
                line = re.sub(f"( ?){link}( ?)", lambda m: " " if m[1] and m[2] else "", line)
                if not BARE.match(line.rstrip("\r\n")):
                    out.append(line)
            body = "".join(out)
    return body


TARGETS = ["a", "x/y/z.md", "note [1] of", "p.q", "$1\\2", "Über (b)", "broken"]


def page(r):
    def link():
        t = r.choice(TARGETS)
        return r.choice(["[[{t}]]", "[[{t}|alias $2]]", "[[{t}#head]]", "[[{t}#head\\|al]]", "![[{t}]]", "[text]({t})", "[te$xt]({t}#top)", "![i]({t})", "[[{t}|(broken link) it]]", "[[other]]"]).replace("{t}", t)

    lines = []
    for _ in range(r.randint(0, 12)):
        lines.append(r.choice(["", "- ", "1. ", "  * ", "text ", "\u201c"]) + " ".join(r.choice([link(), "word", ""]) for _ in range(r.randint(0, 4))) + r.choice(["", "\u201d", " ", "\r"]))
    return "\n".join(lines)


def test_edits_against_each_page(spark):
    r = random.Random(4)
    bodies = {f"w/p{i}.md": page(r) for i in range(400)}
    edits = {p: sorted({t: (t, r.choice(repair.ACTIONS), "new/$t\\x") for t in r.sample(TARGETS, r.randint(0, 3))}.values()) for p in bodies}
    pages = spark.createDataFrame(list(bodies.items()), "path string, body string")
    table = spark.createDataFrame([(p, *e) for p, es in edits.items() for e in es], "path string, target string, action string, new string")
    got = {x["path"]: x["fixed"] for x in repair.repair(pages, table).collect()}
    for p, body in bodies.items():
        if "\r" in body and any(e[1].startswith("delete") for e in edits[p]):
            continue  # lone returns part lines in Python only
        assert got[p] == by_hand(body, edits[p]), (body, edits[p])
    assert sum(got[p] != b for p, b in bodies.items()) > 80


def test_fixes_and_places(spark):
    pages = spark.createDataFrame([
        ("w/home.md", "see [[foo: bar]] and [[sub/Two_Names|x]]\n[[nothing]] [[w/deep/thing]] ![[no]] [m](gone.md#t) [[dup]] [[foo: bar|(broken link) y]]"),
        ("w/foo_ bar.md", ""), ("sub/two names.md", ""), ("a/dup_.md", ""), ("b/dup_.md", ""), ("c/thing.md", ""),
    ], "path string, body string")
    links = ingest.resolve_links(ingest.extract_links(pages), pages)
    found = {(x["target"], x["new"]) for x in repair.fixes(links, pages).collect()}
    assert found == {("foo: bar", "foo_ bar"), ("sub/Two_Names", "sub/two names")}
    fixed = {x["path"]: x["fixed"] for x in repair.repair(pages, repair.fixes(links, pages)).collect()}
    assert fixed["w/home.md"].startswith("see [[foo_ bar]] and [[sub/two names|x]]\n[[nothing]]")
    places = sorted((x["line"], x["column"], x["kind"], x["target"]) for x in repair.link_places(pages).where("path = 'w/home.md'").collect())
    body = pages.first()["body"].split("\n")
    assert [p[3] for p in places] == ["foo: bar", "sub/Two_Names", "nothing", "w/deep/thing", "gone.md", "dup"]
    assert all(body[n - 1][c - 1 :].startswith("[") and t in body[n - 1][c - 1 :] for n, c, _, t in places)


def reference(content, name):
    target = re.compile(r"(?<!\w)" + re.escape(name) + r"(?:\.md)?(?!\w)")
    skip = re.compile(r"\[\[[^\]\n]+\]\]|\[(?:[^\]\n]*)\]\([^)\n]*\)|`[^`\n]*`")
    lines, out, n, end = content.split("\n"), [], 0, 0
    if lines[0].strip() == "---":
        end = next((i + 2 for i, x in enumerate(lines[1:]) if x.strip() in ("---", "...")), 0)
    for i, line in enumerate(lines):
        if i >= end:
            parts, last = [], 0
            for m in [*skip.finditer(line), None]:
                text, k = target.subn(f"[[{name}]]", line[last : m.start() if m else len(line)])
                parts += [text, m[0] if m else ""]
                n, last = n + k, m.end() if m else last
            line = "".join(parts)
        out.append(line)
    return "\n".join(out), n


def test_orphans_are_linked(spark):
    r = random.Random(6)
    names = ["alpha", "beta two", "gam.ma", "al", "Über", "alphabet"]
    words = ["alpha", "alpha.md", "beta two", "beta", "gam.ma", "gamXma", "al", "Über", "alphabet", "`alpha`", "[[beta two]]", "[alpha](x)", "alpha,", "(beta two)", "alphas"]
    bodies = {f"wiki/p{i}.md": r.choice(["", "---\ntitle: alpha\n---\n", "---\nalpha\n"]) + "\n".join(" ".join(r.choice(words) for _ in range(r.randint(0, 5))) for _ in range(4)) for i in range(120)}
    bodies |= {f"wiki/{n}.md": "alpha and beta two" for n in names}
    pages = spark.createDataFrame(list(bodies.items()), "path string, body string")
    orphans = pages.where(pages.path.isin([f"wiki/{n}.md" for n in names]))
    got = {x["path"]: (x["fixed"], x["n_linked"]) for x in repair.link_orphans(pages, orphans).collect()}
    for path, body in bodies.items():
        n = 0
        for name in sorted(x for x in names if len(x) >= 3):
            if path != f"wiki/{name}.md":
                body, k = reference(body, name)
                n += k
        assert got[path] == (body, n), path
