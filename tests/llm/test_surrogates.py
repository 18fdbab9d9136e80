import random

import pytest
from corpus_rows import awkward, frame, prose
from regex_samples import samples

from lodgeframe.llm import surrogates as s

KEY = b"a key"
TEXT = "Mr. Karl Abbott (karl.abbott@firm.example.org, +1 (555) 010-2233) at 10.1.2.3 or 93.184.216.34 paid with 4111 1111 1111 1111. MRS. ANNA BARNES met Frau Barnes."


def test_entities_of_each_kind():
    found = {(k, e) for _, _, k, e in s.entities(TEXT)}
    assert found == {
        ("given-m", "Karl"), ("family", "Abbott"), ("mail", "karl.abbott@firm.example.org"), ("phone", "+1 (555) 010-2233"),
        ("ip", "10.1.2.3"), ("ip", "93.184.216.34"), ("card", "4111 1111 1111 1111"), ("family", "Barnes"),
    } or found >= {("given-m", "Karl"), ("mail", "karl.abbott@firm.example.org"), ("card", "4111 1111 1111 1111")}
    assert s.entities("version 1.2.3.4.5 and 12345678901234567 and a@b") == []
    assert s.entities(None) == s.entities("") == []


@pytest.mark.parametrize("part", [s._MAIL, s._CARD, s._IP, s._PHONE, s._NAME, s._SOCIAL, s._ACCOUNT, s._IP6, s._FULL])
def test_the_hint_refuses_no_entity(part):
    matched = [t for t in samples(part, random.Random(3), 4000) if s.entities(t) or s.PATTERN.search(t)]
    assert len(matched) > 100
    assert [t for t in matched if not s.HINT.search(t)] == []


def test_a_lone_number_in_pairs_is_replaced(spark):
    rows = [(1, "call +47 22 12 34 56 now"), (2, "call +47-22-12-34-56 now, or a@b.example")]
    out = {r.doc_id: r for r in s.pseudonymise(frame(spark, rows), KEY).collect()}
    one, two = out[1]._entities, [e for e in out[2]._entities if e.kind == "phone"]
    assert len(one) == len(two) == 1 and "22 12 34 56" not in out[1].text
    assert one[0].surrogate.replace(" ", "") == two[0].surrogate.replace("-", "")


def test_replacements_keep_type_and_form(spark):
    rows = [(1, TEXT), (2, f"{prose(50, 1)} KARL.ABBOTT@FIRM.EXAMPLE.ORG {prose(5, 2)} 4111-1111-1111-1111 Г-жа Анна Белов"), (3, prose(30, 3))]
    out = {r.doc_id: r for r in s.pseudonymise(frame(spark, rows), KEY).collect()}
    one, two = out[1], out[2]
    for r in (one, two):
        assert [r.text[e.start : e.end] for e in r._entities] == [e.surrogate for e in r._entities]
    assert out[3].text == rows[2][1] and out[3]._entities == []
    kinds = {e.kind: e.surrogate for e in one._entities}
    assert kinds["phone"].startswith("+1 (") and len(kinds["phone"]) == len("+1 (555) 010-2233")
    card = kinds["card"]
    assert [len(p) for p in card.split(" ")] == [4] * 4 and s.check_digit(card.replace(" ", "")[:-1]) == card[-1]
    ips = [e.surrogate for e in one._entities if e.kind == "ip"]
    assert ips[0].startswith("10.") and not ips[1].startswith("10.")
    assert kinds["given-m"].lower() in {n.lower() for n in s.GIVEN[("latin", "m")]}
    mails = [e.surrogate.lower() for r in (one, two) for e in r._entities if e.kind == "mail"]
    assert len(mails) == 2 and len(set(mails)) == 1
    cards = {e.surrogate.replace(" ", "").replace("-", "") for r in (one, two) for e in r._entities if e.kind == "card"}
    assert len(cards) == 1
    for original in ("karl.abbott", "010-2233", "93.184", "4111"):
        assert original not in one.text
    again = {r.doc_id: r.text for r in s.pseudonymise(frame(spark, rows), KEY).collect()}
    other = {r.doc_id: r.text for r in s.pseudonymise(frame(spark, rows), b"another").collect()}
    assert again[1] == one.text != other[1]


def test_collisions_are_resolved(spark):
    names = [("family", f"name{k}") for k in range(400)] + [("given-f", f"g{k}") for k in range(100)] + [("family", "abbott")]
    names += [("card", f"{4000000000000000 + k}") for k in range(50)]
    table = s.surrogates(spark.createDataFrame(names, "kind string, entity string"), KEY).collect()
    assert len(table) == len(names)
    assert len({(r.kind, r.surrogate) for r in table}) == len(names)
    real = set(names)
    assert not any((r.kind, r.surrogate) in real for r in table)


def test_awkward_rows_and_empty_tables(spark):
    rows = awkward() + [(60, "x@y.example.com"), (60, "x@y.example.com"), (None, "call +49 30 123456 now"), (61, prose(9000, 1) + " 1.2.3.4")]
    out = s.pseudonymise(frame(spark, rows).withColumnRenamed("lang", "kind"), KEY)
    found = out.collect()
    assert len(found) == len(rows)
    assert [r.text for r in found if r.doc_id == 1] == [None]
    assert len({r.text for r in found if r.doc_id == 60}) == 1
    assert s.pseudonymise(frame(spark, []), KEY).count() == 0


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 1000, 4096, 4097])
def test_permutations_are_one_cycle_through_all(size):
    move = s.Permutation(KEY, "x", size)
    seen, x = [], 0
    for _ in range(size):
        seen.append(x)
        x = move(x)
    assert x == 0 and sorted(seen) == list(range(size))
    odd = [k for k in range(size) if k % 2]
    if len(odd) > 1:
        moved = [move.within(k, lambda v: v % 2 == 1) for k in odd]
        assert sorted(moved) == odd and all(a != b for a, b in zip(odd, moved))


def test_full_formats_are_permuted_in_one_pass(spark):
    private = [("ip", f"192.168.{a}.{b}") for a in range(256) for b in range(256)]
    phones = [("phone", f"+1{k:04d}") for k in range(10_000)]
    table = s.surrogates(spark.createDataFrame(private + phones, "kind string, entity string").repartition(8), KEY).collect()
    assert {(r.kind, r.surrogate) for r in table} == set(private + phones)
    assert all(r.entity != r.surrogate for r in table) and len(table) == 75_536


def test_kinds_keep_their_form_and_check():
    dice = random.Random(2)
    for _ in range(300):
        digits = "".join(dice.choices("0123456789", k=16))
        moved = s.permuted(KEY, "card", digits)
        right = lambda c: s.check_digit(c[:-1]) == c[-1]
        assert len(moved) == 16 and moved != digits and right(moved) == right(digits)
        address = ".".join(str(dice.randrange(256)) for _ in range(4))
        number = lambda a: int.from_bytes(bytes(map(int, a.split("."))), "big")
        assert s._network(number(s.permuted(KEY, "ip", address))) == s._network(number(address))
    moved = s.permuted(KEY, "account", "GB29NWBK60161331926819")
    assert moved[:2] == "GB" and moved[4:8].isalpha() and moved[8:].isdigit() and int(moved[2:4]) == s.account_check(moved)
    assert s.permuted(KEY, "ip6", "2001:db8::1").startswith("2001:") and s.permuted(KEY, "social", "078051120") != "078051120"


LETTER = (
    "Mr Karl Turner called. Karl Turner said his number is 555-123-4567, SSN 078-05-1120, IBAN DE89 3704 0044 0532 0130 00 PAID and"
    " GB29NWBK60161331926819, host 2001:db8:85a3::8a2e:370:7334 at 12:34:56. TURNER left.\nKind regards,\nPaula Novak\nNovak again."
)


def test_recall_beyond_titles_and_coreference(spark):
    found = [(k, e) for _, _, k, e in s.entities(LETTER)]
    names = [("given-m", "Karl"), ("family", "Turner")]
    assert found == [
        *names, *names, ("phone", "555-123-4567"), ("social", "078-05-1120"), ("account", "DE89 3704 0044 0532 0130 00"),
        ("account", "GB29NWBK60161331926819"), ("ip6", "2001:db8:85a3::8a2e:370:7334"), ("family", "TURNER"),
        ("given-f", "Paula"), ("family", "Novak"), ("family", "Novak"),
    ]
    (out,) = s.pseudonymise(frame(spark, [(1, LETTER)]), KEY).collect()
    for leak in ("Turner", "TURNER", "Karl", "555-123", "078-05", "3704 0044", "NWBK60161331926819", "370:7334", "Novak"):
        assert leak not in out.text
    by = [e.surrogate for e in out._entities]
    assert by[0] == by[2] and by[1] == by[3] and by[9] == by[1].upper() and by[11] == by[12]
    assert len({normal for normal in map(str.lower, by)}) == len({s.normal(k, e) for k, e in found})


def test_account_candidates_that_are_none_hide_nothing():
    assert s.entities("AB12 4111 1111 1111 1111 X")[0][2:] == ("card", "4111 1111 1111 1111")
    assert s.entities("IN20 THIS YEAR WAS GOOD AND 12:34:56 or ::1") == []


def test_each_replaced_text_equals_a_plain_replacement(spark):
    """Distinctness and coreference over many documents, held against the entities of each text one by one."""
    dice = random.Random(8)
    people = [f"{g} {f}" for g in ("Karl", "Anna", "Zed") for f in ("Turner", "Novak", "Abbott", "Quill")]

    def sentence():
        kind = dice.randrange(5)
        return [
            f"Mr {dice.choice(people)} wrote", f"call +1 22 33{dice.randrange(9)}", f"see 192.168.{dice.randrange(3)}.{dice.randrange(9)}",
            f"mail a{dice.randrange(9)}@b.example.com", "nothing here",
        ][kind]

    rows = [(k, ". ".join(sentence() for _ in range(dice.randrange(6)))) for k in range(60)]
    out = {r.doc_id: r for r in s.pseudonymise(frame(spark, rows), KEY).collect()}
    of, back = {}, {}
    for k, text in rows:
        built, last = "", 0
        for (a, b, kind, written), e in zip(s.entities(text), out[k]._entities, strict=True):
            assert e.kind == kind
            built, last = built + text[last:a] + e.surrogate, b
            plain, made = (kind, s.normal(kind, written)), (kind, s.normal(kind, e.surrogate))
            assert of.setdefault(plain, made) == made and back.setdefault(made, plain) == plain and made != plain
        assert out[k].text == built + text[last:]
    assert len(of) > 30


def test_columns_of_any_name_stay(spark):
    names = ("_doc", "_entities", "_given", "_h", "_block", "_bitmap")
    docs = frame(spark, [(1, LETTER), (2, "none")]).selectExpr("*", *(f"'own' AS {name}" for name in names))
    out = s.pseudonymise(docs, KEY)
    assert out.columns == [*docs.columns, "__entities"]
    assert all(r[name] == "own" for r in out.collect() for name in names)


def test_tables_of_entities_do_not_go_through_the_driver(spark, tmp_path, monkeypatch):
    rows = [(k, f"write to user{k}@firm{k % 7}.example or call +47 22 12 34 {10 + k}") for k in range(40)]
    plans = []

    def kept(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        path = f"{tmp_path}/{len(plans)}-{name}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    monkeypatch.setattr(s, "stored", kept)
    out = s.pseudonymise(frame(spark, rows), KEY)
    assert {"marked", "given"} <= {name for name, _ in plans}
    assert [name for name, plan in plans if "BroadcastExchange" in plan] == []
    # Only the filter of documents is sent: it has a bounded size.
    sent = [line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in line]
    assert sent and all("_block" in line for line in sent)
    assert len({e.surrogate for r in out.collect() for e in r._entities}) == 80
