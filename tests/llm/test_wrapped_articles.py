"""An article is kept whatever the names around it say."""

from quietline.llm import html


def test_wrapped_articles():
    tree = html.fitted()
    body = "<h1>A B</h1>" + "".join(f"<p>{' '.join(f'w{k}' for k in range(n))}.</p>" for n in (40, 25, 60))
    menu = '<nav><ul><li><a href="/">Home</a></li><li><a href="/x">More</a></li></ul></nav>'
    want = html.main_text(f"<body><article>{body}</article></body>", tree)
    assert want.count("\n\n") == 3
    for name in ('class="layout has-sidebar"', 'class="no-ads"', 'class="with-comments"', 'id="social-science"', 'class="legal-text"', 'class="related-page"', 'role="search"'):
        for tag in ("article", "main"):
            assert html.main_text(f'<body><div {name}>{menu}<{tag}>{body}</{tag}></div><footer>End</footer></body>', tree) == want, name
    assert html.main_text(f"<body><form>{menu}<article>{body}</article></form></body>", tree) == want
    # What isn't the article stays out, in a wrapper and after an article in it.
    aside = "".join(f"<article><p>Other story number {k} that you may like.</p></article>" for k in range(3))
    for other in (f'<div class="related">{aside}</div>', f"<aside>{aside}</aside>", f'<div hidden><article><p>{"no " * 30}</p></article></div>', '<div class="comments"><article class="comment"><p>Nice one, I say.</p></article></div>'):
        assert html.main_text(f'<body><div class="legal-text"><article>{body}</article>{other}<div class="notice"><p>We say this.</p></div></div></body>', tree) == want, other
