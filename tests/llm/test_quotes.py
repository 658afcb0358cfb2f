from tidemark.llm import quotes as q


def test_levels_and_own_text():
    text = "On Monday Ann wrote:\n> first words\n>> older words\n> > same level\n> back\nmy answer\n> tail"
    assert q.levels(text) == [(0, "On Monday Ann wrote:"), (1, "first words"), (2, "older words\nsame level"), (1, "back"), (0, "my answer"), (1, "tail")]
    assert q.own_text(text) == "\nmy answer".strip("\n")
    assert q.own_text("a > b is no quote") == "a > b is no quote" and q.own_text(None) == "" and q.own_text("") == ""


def mail(i):
    return f"message {i} says that number {i * 7} is the one we shall discuss on day {i} of the month"


def test_links_threads_and_order(spark):
    rows = [
        (1, 0, "user", mail(0)),
        (1, 1, "assistant", f"x wrote:\n> {mail(0)}\n\n{mail(1)}"),
        (1, 2, "user", f"> {mail(0)}\nanother answer to the first message of all"),
        (1, 3, "assistant", f">> {mail(0)}\n> {mail(1)}\nlate reply to one, which itself quotes zero"),
        (1, 4, "user", "> words that nobody has ever written in this conversation here\nplain"),
        (2, 0, "user", mail(9)),
        (2, 5, "assistant", "no quotation at all"),
        (3, 1, "user", None),
        (3, 2, "user", ""),
        (3, 2, "user", "> " + mail(9)),
        (None, 1, "user", "lost > text"),
        (4, None, "user", f"> {mail(0)}\nrest"),
        (5, 0, "user", "word " * 40_000),
        (5, 1, "user", "> " + "word " * 40_000 + "\nyes"),
    ]
    m = spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id long, turn int, role string, text string, c string, t int")
    got = q.format_conversations(m).collect()
    assert len(got) == len(rows)
    by = {(r.conv_id, r.turn): r for r in got}
    assert [by[1, t].reply_to for t in range(5)] == [None, 0, 0, 1, 3]
    assert [by[1, t].n_linked for t in range(5)] == [0, 1, 1, 2, 0]
    assert [by[1, t].max_level for t in range(5)] == [0, 1, 1, 2, 1]
    assert [by[1, t].place for t in range(5)] == [0, 1, 4, 2, 3]
    assert [by[1, t].depth for t in range(5)] == [0, 1, 1, 2, 3]
    assert by[1, 1].text == "\n" + mail(1) or by[1, 1].text == mail(1)
    assert by[2, 5].reply_to == 0 and by[5, 1].reply_to == 0 and by[5, 1].n_linked == 1
    assert by[None, 1].place is None and by[None, 1].text == "lost > text"
    assert by[4, None].place is None and by[4, None].text == "rest"
    chats = {r.conv_id: r.messages for r in q.chat_documents(q.format_conversations(m)).collect()}
    assert [x.turn for x in chats[1]] == [0, 1, 3, 4, 2] and all(">" not in (x.text or "") for x in chats[1])
    assert q.format_conversations(m.limit(0)).count() == 0


def test_across_conversations(spark):
    rows = [(1, 0, "user", mail(3)), (7, 2, "user", f"> {mail(3)}\nfrom elsewhere")]
    m = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    assert [tuple(r) for r in q.link_quotes(m, across=True).select("c", "t", "to_c", "to_t", "share").collect()] == [(7, 2, 1, 0, 1.0)]
    assert q.link_quotes(m).count() == 0


def test_links_against_brute_force(spark):
    import random

    rnd = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for c in range(6):
        said = []
        for t in range(9):
            own = " ".join(rnd.choices(words, k=rnd.randint(1, 25)))
            quote = ""
            if said and rnd.random() < 0.7:
                source = rnd.choice(said).split()
                a = rnd.randrange(len(source))
                part = source[a : a + rnd.randint(1, 20)]
                if rnd.random() < 0.3:
                    part[rnd.randrange(len(part))] = "changed"
                quote = "> " + " ".join(part) + "\n"
            said.append(own)
            rows.append((c, t, "user", quote + own))
    rows += [(9, t, "user", ("> thanks\n" if t % 3 == 2 else "") + "thanks") for t in range(60)]  # the same, over and over
    m = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    want = {}
    for c, t, _, text in rows:
        if not text.startswith("> "):
            continue
        said = text.split("\n")[0][2:].split()
        k = min(5, len(said))
        windows = {tuple(said[i : i + k]) for i in range(len(said) - k + 1)}
        best = None
        for c2, t2, _, other in rows:
            if c2 == c and t2 < t:
                own = other.split("\n")[-1].split()
                share = len(windows & {tuple(own[i : i + k]) for i in range(len(own) - k + 1)}) / len(windows)
                if share >= 0.8:
                    best = max(best or (0, 0), (share, t2))
        if best:
            want[c, t] = (best[1], best[0])
    got = {(r.c, r.t): (r.to_t, r.share) for r in q.link_quotes(m).collect()}
    assert got == want and len(want) > 40 and any(len(x[3].split("\n")[0].split()) < 5 for x in rows if (x[0], x[1]) in want)


def test_short_quotations_and_earlier_conversations(spark):
    rows = [(1, 0, "user", "I think we should all meet at noon tomorrow near the station"), (1, 1, "user", "> meet at noon\nfine"), (1, 2, "user", "> station\nwhich"), (1, 3, "user", "> noon meet\nno"), (2, 4, "user", "> all meet\nyes")]
    m = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    assert {(r.c, r.t): (r.to_c, r.to_t) for r in q.link_quotes(m).collect()} == {(1, 1): (1, 0), (1, 2): (1, 0)}
    assert {(r.c, r.t): (r.to_c, r.to_t) for r in q.link_quotes(m, across=True).collect()} == {(1, 1): (1, 0), (1, 2): (1, 0), (2, 4): (1, 0)}


def test_long_conversations_are_ordered_alike(spark):
    import random

    rnd = random.Random(7)
    rows = []
    for c in (1, 2, 3):
        turns = sorted(rnd.sample(range(-5, 400), 90))
        for i, t in enumerate(turns):
            rows.append((c, t, None if i == 0 or rnd.random() < 0.05 else turns[rnd.randrange(max(0, i - 12), i)], 0, False))
    tree = spark.createDataFrame(rows, "c long, t long, reply_to long, n_linked long, linked boolean")
    want = {tuple(r) for r in q._streamed_order(tree).collect()}
    assert {tuple(r) for r in q._reply_order(tree, held=10).collect()} == want and len(want) == 270


def test_nested_top_posted_quotes_are_linked(spark):
    intro = "On Tue, 3 May 2022 at 10:11, Bob Smith wrote:"
    say = lambda k: " ".join(f"{k}word{i}" for i in range(20))
    first = say("a")
    second = f"{say('b')}\n\n{intro}\n\n> {first}"
    third = f"{say('c')}\n\n{intro}\n\n> {say('b')}\n>\n> {intro}\n>\n> > {first}"
    rows = [(1, 0, "user", first), (1, 1, "user", second), (1, 2, "user", "between"), (1, 3, "user", third)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    links = {(r.t, r.level): (r.to_t, r.share) for r in q.link_quotes(df).collect()}
    assert links == {(1, 1): (0, 1.0), (3, 1): (1, 1.0), (3, 2): (0, 1.0)}
    assert {r.turn: r.reply_to for r in q.format_conversations(df).collect()} == {0: None, 1: 0, 2: 1, 3: 1}
