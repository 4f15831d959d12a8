import threading

import pytest

from lodeseek.sources import kv


def pairs(df):
    return sorted((r.bucket, bytes(r.key).decode(), bytes(r.value).decode()) for r in df.collect())


@pytest.fixture(scope="module")
def view(spark):
    rows = [("foo", str(i), str(i)) for i in range(10)] + [("bar", str(i), str(i)) for i in range(100)] + [("baz", "key", "value"), ("baz/sub", "k", "v")]
    return spark.createDataFrame([(b, k.encode(), v.encode()) for b, k, v in rows], kv.SCHEMA).cache()


def keys(df):
    return [bytes(r.key).decode() for r in df.collect()]


def test_reading(view):
    assert pairs(kv.get(view, "baz", "key")) == [("baz", "key", "value")] and kv.get(view, "baz", "sub").count() == 0
    assert kv.has(view, "foo", "3") and not kv.has(view, "foo", "33")
    assert keys(kv.scan(view, "bar")) == sorted(map(str, range(100)))
    assert keys(kv.prefix(view, "bar", "9")) == ["9", *[f"9{i}" for i in range(10)]]
    assert keys(kv.between(view, "bar", "10", "12")) == ["10", "11", "12"]
    assert keys(kv.seek(view, "bar", "995")) == [] and keys(kv.seek(view, "bar", "985")) == ["99"] and keys(kv.seek(view, "bar", "98")) == ["98"]
    assert keys(kv.after(view, "bar", "98")) == ["99"] and keys(kv.before(view, "bar", "0")) == [] and keys(kv.before(view, "bar", "1")) == ["0"]
    assert {(r.bucket, bytes(r.first), bytes(r.last)) for r in kv.first_last(view).where("bucket in ('foo', 'bar')").collect()} == {("foo", b"0", b"9"), ("bar", b"0", b"99")}
    near = {bytes(r.key): (r.previous and bytes(r.previous), r.next and bytes(r.next)) for r in kv.neighbours(view).where("bucket = 'foo'").collect()}
    assert near[b"0"] == (None, b"1") and near[b"5"] == (b"4", b"6") and near[b"9"] == (b"8", None)
    assert tuple(kv.totals(view.where("bucket != 'baz/sub'")).first()) == (3, 111)
    assert tuple(kv.totals(view.limit(0)).first()) == (0, 0)
    assert {(r.bucket, r["keys"], r.key_bytes, r.value_bytes) for r in kv.statistics(view).where("bucket = 'foo'").collect()} == {("foo", 10, 10, 10)}
    assert kv.in_bucket(view, "baz", nested=True).count() == 2 and kv.problems(view).count() == 0
    assert [r.seq for r in kv.sequenced(view.where("bucket = 'foo'"), "bucket", "key", 5).orderBy("key").collect()] == list(range(6, 16))


def test_problems(spark):
    bad = spark.createDataFrame([("b", b"x", b"1"), ("b", b"x", b"2"), ("b", b"", b"1"), ("b", None, b"1"), ("b", b"k" * 40000, b"1"), ("b", b"fine", b"1")], kv.SCHEMA)
    assert kv.problems(bad).count() == 4


def test_transactions(spark, folder):
    store = kv.Store(spark, folder)
    assert store.view().count() == 0
    called = []
    with store.update() as tx:
        tx.create_bucket("b")
        tx.create_bucket_if_absent("b")
        tx.create_bucket("b/in")
        tx.put("b", "k", "1")
        tx.put("b", "k", "2")
        tx.put("b", "gone", "x")
        tx.delete("b", "gone")
        tx.delete("b", "never")
        tx.put_json("b/in", "j", {"a": 1})
        assert tx.next_sequence("b") == 1 and tx.next_sequence("b") == 2
        tx.on_commit(lambda: called.append(1))
        assert pairs(tx.view()) == [("b", "k", "2"), ("b/in", "j", '{"a": 1}')] and store.view().count() == 0
    assert called == [1] and pairs(store.view()) == [("b", "k", "2"), ("b/in", "j", '{"a": 1}')]
    reader = store.read()
    with store.update() as tx:
        assert tx.next_sequence("b") == 3
        tx.put_all("b", spark.createDataFrame([("k", "3"), ("m", "4")], "key string, value string"))
        tx.put("b", "m", "5")
    assert pairs(reader.view())[0] == ("b", "k", "2") and pairs(store.view())[:2] == [("b", "k", "3"), ("b", "m", "5")]
    with pytest.raises(RuntimeError), store.update() as tx:
        tx.put("b", "k", "lost")
        raise RuntimeError
    assert pairs(store.view())[0] == ("b", "k", "3")
    with store.update() as tx:
        for bad in (lambda: tx.put("b", "", "x"), lambda: tx.put("b", "k" * 40000, "x"), lambda: tx.put("none", "k", "x"), lambda: tx.put("b", "in", "x"), lambda: tx.delete("b", "in"), lambda: tx.create_bucket("b"), lambda: tx.create_bucket(""), lambda: tx.create_bucket("b/k"), lambda: tx.create_bucket("no/sub"), lambda: tx.delete_bucket("none"), lambda: tx.put_all("b", spark.createDataFrame([("", "3")], "key string, value string"))):
            with pytest.raises(kv.KeyValueError):
                bad()
        tx.delete_bucket("b/in")
    with pytest.raises(kv.KeyValueError):
        reader.put("b", "k", "x")
    with pytest.raises(kv.KeyValueError):
        tx.put("b", "k", "late")
    assert pairs(store.view()) == [("b", "k", "3"), ("b", "m", "5")]
    before = pairs(store.view())
    store.compact()
    assert pairs(store.view()) == before and pairs(store.view(1)) == [("b", "k", "2"), ("b/in", "j", '{"a": 1}')]
    store.backup(folder + "-copy")
    copy = kv.Store(spark, folder + "-copy")
    assert pairs(copy.view()) == before and copy.read().sequence("b") == 3
    assert store.describe() == "b: 2 keys\nOK"


def test_one_writer_at_a_time(spark, folder):
    store = kv.Store(spark, folder)
    tx = store.update()
    tx.create_bucket("b")
    order = []

    def second():
        with store.update() as other:
            order.append("second")
            assert "b" in other.buckets

    t = threading.Thread(target=second)
    t.start()
    order.append("first")
    tx.commit()
    t.join(60)
    assert order == ["first", "second"]


def test_batches(spark, folder):
    store = kv.Store(spark, folder)
    with store.update() as tx:
        tx.create_bucket("b")
    number = store.versions()[-1]
    good = [store.batch(lambda t, i=i: t.put("b", f"k{i}", str(i))) for i in range(3)]
    bad = store.batch(lambda t: t.put("nothing", "k", "v"))
    store.flush()
    assert [f.result() for f in good] == [None] * 3 and isinstance(bad.exception(), kv.KeyValueError)
    assert len(pairs(store.view())) == 3 and store.versions()[-1] == number + 1
