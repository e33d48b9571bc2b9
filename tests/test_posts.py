from tessera import posts

POST = """# A & B

Text with **bold**, *thin* and `code` [^2] [^1].

- one
- two

1. first

| a | b |
|---|---|
| 1 | <2> |

```chartjs
{"type": "bar"}
```

```chartjs
broken
```

```chart
{"type": "no chart of a post"}
```

[^2]: Second
[^10]: Tenth
[^1]: First"""


def test_page():
    body = posts.post_body(POST)
    assert "<h1>A &amp; B</h1>" in body and "<strong>bold</strong>" in body and "<em>thin</em>" in body
    assert "<ul><li>one</li><li>two</li></ul>" in body and "<ol><li>first</li></ol>" in body
    assert "<th>a</th>" in body and "<td>&lt;2&gt;</td>" in body
    assert body.count("<canvas") == 1 and "<pre><code>broken</code></pre>" in body
    assert [k for k, _ in posts.footnotes(POST)] == ["1", "2", "10"] and posts.charts(POST) == [{"type": "bar"}]
    assert "<title>A &amp; B</title>" in posts.post_page(POST)


def test_files(tmp_path):
    md, page = posts.export_post(POST, str(tmp_path), "my topic")
    assert md.endswith("my_topic_post.md") and open(md).read() == POST and open(page).read().startswith("<!DOCTYPE html>")
