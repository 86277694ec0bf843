"""Every batch operator equals handling its requests one after another."""

import datetime as dt
import random

import pytest
from model import Shop

from pillflow import schemas as S
from pillflow.operators.accounts import Registration, remove_users
from pillflow.operators.carts import CartScans, Checkout
from pillflow.operators.dispenser import Fill, Return
from pillflow.operators.expiry import refresh_warnings
from pillflow.operators.orders import Cancellation, set_order_status
from pillflow.operators.stockroom import Intake, Removal

TODAY = dt.date(2000, 1, 1)
NOW = dt.datetime(2000, 1, 1, 8, 30)
SEEDS = range(3)


def barcode(rng, n=60):
    return str(10000000 + rng.randrange(n))


def any_barcode(rng, n=60):
    odd = ["", None, "1234567", "12345678901234", "abc45678", "10000001\n", "１２３４５６７８"]
    return rng.choice(odd) if rng.random() < 0.15 else barcode(rng, n)


def a_day(rng):
    return None if rng.random() < 0.05 else TODAY + dt.timedelta(days=rng.choice([-400, -1, 0, 1, 300]))


def a_shop(seed):
    """A shop in which each name has one channel at most."""
    rng = random.Random(seed)
    shop = Shop(TODAY, NOW)
    channels = {f"name {i}": f"Kanal {k}" for i, k in enumerate(rng.sample(range(1, 30), 12))}
    for _ in range(40):
        name = f"name {rng.randrange(20)}"
        inside = name in channels and rng.random() < 0.6
        shop.stock[barcode(rng)] = [name, rng.randrange(1, 5), a_day(rng), "Automat" if inside else "Lager",
                                    channels[name] if inside else None]
    for i in range(60):
        shop.orders.append([i + 1, 100000 + rng.randrange(20), f"K{rng.randrange(3)}", barcode(rng, 90),
                            f"name {rng.randrange(20)}", dt.datetime(1999, 12, rng.randrange(1, 28)), rng.choice(S.STATUSES)])
    for i in range(10):
        shop.users[f"user {i}"] = [i + 1, str(10000000 + 2 * i), "user"]
    for _ in range(25):
        shop.warnings[barcode(rng, 90)] = [f"name {rng.randrange(20)}", a_day(rng), "Lager", rng.choice(["Offen", "alt"])]
    return rng, shop


def frames(spark, shop):
    return {
        "stock": spark.createDataFrame([(b, *r) for b, r in shop.stock.items()], S.STOCK),
        "orders": spark.createDataFrame([tuple(o) for o in shop.orders], S.ORDERS),
        "users": spark.createDataFrame([(u[0], u[1], n, u[2]) for n, u in shop.users.items()], S.USERS),
        "warnings": spark.createDataFrame([(b, *w) for b, w in shop.warnings.items()], S.WARNINGS),
    }


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=repr)


def same_stock(df, shop):
    assert rows(df, *S.STOCK.names) == sorted(((b, *r) for b, r in shop.stock.items()), key=repr)


def same_orders(df, shop):
    assert rows(df, *S.ORDERS.names) == sorted((tuple(o) for o in shop.orders), key=repr)


@pytest.mark.parametrize("seed", SEEDS)
def test_intake(spark, seed):
    rng, shop = a_shop(seed)
    before = frames(spark, shop)
    dates = ["2000-01-01", "2000-1-2", "1999-12-31", "2001-05-05", "2000-02-30", "bald", "", None, "2001-05-05 ", "02001-05-05"]
    requests = [(i, any_barcode(rng, 120), rng.choice(["a", "b", "", None]) if rng.random() < 0.2 else "c",
                 rng.choice(dates[:4]) if rng.random() < 0.7 else rng.choice(dates), rng.choice(["Lager", "Automat", None]))
                for i in rng.sample(range(1000), 300)]
    result = Intake(before["stock"], before["orders"], spark.createDataFrame(requests, S.INTAKE_REQUESTS), TODAY)
    expected = [(r[0], shop.take_in(*r[1:])) for r in sorted(requests)]
    assert rows(result.outcomes, "seq", "code") == sorted(expected, key=repr)
    same_stock(result.stock, shop)
    assert len({code for _, code in expected}) == 6


@pytest.mark.parametrize("seed", SEEDS)
def test_removal(spark, seed):
    rng, shop = a_shop(seed)
    stock = frames(spark, shop)["stock"]
    requests = [(i, any_barcode(rng)) for i in rng.sample(range(1000), 80)]
    result = Removal(stock, spark.createDataFrame(requests, S.BARCODE_REQUESTS))
    expected = [(seq, shop.remove(b)) for seq, b in sorted(requests, key=lambda r: r[0])]
    assert rows(result.outcomes, "seq", "code") == sorted(expected, key=repr)
    same_stock(result.stock, shop)


@pytest.mark.parametrize("seed", SEEDS)
def test_fill(spark, seed):
    rng, shop = a_shop(seed)
    stock = frames(spark, shop)["stock"]
    requests = [(i, any_barcode(rng)) for i in rng.sample(range(1000), 120)]
    result = Fill(stock, spark.createDataFrame(requests, S.BARCODE_REQUESTS), TODAY)
    expected = [(seq, *shop.fill(b)) for seq, b in sorted(requests, key=lambda r: r[0])]
    assert rows(result.outcomes, "seq", "code", "detail") == sorted(expected, key=repr)
    same_stock(result.stock, shop)


@pytest.mark.parametrize("seed", range(5))
def test_fill_with_names_in_several_channels(spark, seed):
    """Refilled goods go to the lowest channel of their name, and channels left empty are given out again."""
    rng = random.Random(100 + seed)
    shop = Shop(TODAY, NOW)
    numbers = rng.sample(range(1, 40), 30)
    for i in range(90):
        name = f"name {rng.randrange(30)}"
        inside = rng.random() < 0.5 and name < "name 2"
        shop.stock[str(10000000 + i)] = [name, 1, dt.date(2001, 1, 1) if rng.random() < 0.9 else None, "Automat" if inside else "Lager",
                                         f"Kanal {rng.choice(numbers)}" if inside else None]
    before = {tuple(r[3:]) for r in shop.stock.values() if r[4]}
    requests = [(i, barcode(rng, 95)) for i in rng.sample(range(1000), 160)]
    stock = frames(spark, shop)["stock"]
    expected = [(seq, *shop.fill(b)) for seq, b in sorted(requests, key=lambda r: r[0])]
    result = Fill(stock, spark.createDataFrame(requests, S.BARCODE_REQUESTS), TODAY)
    assert rows(result.outcomes, "seq", "code", "detail") == sorted(expected, key=repr)
    same_stock(result.stock, shop)
    assert result._released.count() > 0 and before


@pytest.mark.parametrize("seed", range(4))
def test_lowest_free_numbers(spark, seed):
    """Against handing out numbers one by one from a heap."""
    import heapq

    from pillflow.operators.ranking import take_lowest
    rng = random.Random(seed)
    times = rng.sample(range(1, 500), 80)
    needs, freed = times[:40 + 10 * seed], times[40 + 10 * seed:]
    values = rng.sample(range(1, 200), len(needs) + len(freed))
    numbers = [(v, -1) for v in values[:len(needs)]] + list(zip(values[len(needs):], freed))
    pool, expected, waiting = [], [], sorted((s, v) for v, s in numbers)
    for at in sorted(needs):
        while waiting and waiting[0][0] < at:
            heapq.heappush(pool, waiting.pop(0)[1])
        expected.append((at, heapq.heappop(pool)))
    found = take_lowest(spark.createDataFrame([(t,) for t in needs], "at long"), spark.createDataFrame(numbers, "nummer long, since long"))
    assert rows(found, "at", "nummer") == sorted(expected, key=repr)


@pytest.mark.parametrize("seed", SEEDS)
def test_return(spark, seed):
    rng, shop = a_shop(seed)
    stock = frames(spark, shop)["stock"]
    requests = [(i, any_barcode(rng)) for i in rng.sample(range(1000), 80)]
    result = Return(stock, spark.createDataFrame(requests, S.BARCODE_REQUESTS))
    expected = [(seq, *shop.give_back(b)) for seq, b in sorted(requests, key=lambda r: r[0])]
    assert rows(result.outcomes, "seq", "code", "detail") == sorted(expected, key=repr)
    same_stock(result.stock, shop)


@pytest.mark.parametrize("seed", SEEDS)
def test_cart_scans(spark, seed):
    rng, shop = a_shop(seed)
    stock = frames(spark, shop)["stock"]
    scans = [(rng.randrange(4), i, any_barcode(rng)) for i in range(200)]
    result = CartScans(stock, spark.createDataFrame(scans, S.CART_LINES), TODAY)
    carts = {}
    expected = [(c, i, shop.scan(carts.setdefault(c, set()), b)) for c, i, b in scans]
    assert rows(result.outcomes, "cart_id", "line_no", "code") == sorted(expected, key=repr)
    assert {c: {b for x, b in rows(result.cart_lines, "cart_id", "barcode") if x == c} for c in carts} == carts


def check_out(spark, shop, carts, lines):
    before = frames(spark, shop)
    result = Checkout(before["stock"], before["orders"], spark.createDataFrame(carts, S.CARTS),
                      spark.createDataFrame(lines, S.CART_LINES), NOW)
    expected = [(c, *shop.check_out(k, [b for x, _, b in sorted(lines) if x == c])) for c, k in sorted(carts)]
    assert rows(result.outcomes, "cart_id", "code", "detail") == sorted(expected, key=repr)
    same_stock(result.stock, shop)
    same_orders(result.orders, shop)
    return result


@pytest.mark.parametrize("seed", SEEDS)
def test_checkout(spark, seed):
    rng, shop = a_shop(seed)
    for i in range(60):
        shop.stock[str(20000000 + i)] = ["x", 1, TODAY, "Automat", "Kanal 50"]
    carts = [(c, rng.choice(["K1", "K2", "K3", "", None]) if rng.random() < 0.3 else "K4") for c in range(70)]
    lines = [(c, n, str(20000000 + rng.randrange(60)) if rng.random() < 0.97 else any_barcode(rng) or "10000000")
             for c in range(65) for n in range(rng.choice([1, 1, 2, 3]))]
    check_out(spark, shop, carts, lines)


def test_checkout_chain(spark):
    """Each cart shares goods with the next: the loser of one pair must not block the cart after it."""
    shop = Shop(TODAY, NOW)
    for i in range(8):
        shop.stock[str(20000000 + i)] = ["x", 1, TODAY, "Automat", "Kanal 1"]
    lines = [(c, n, str(20000000 + c + n)) for c in range(7) for n in range(2)]
    result = check_out(spark, shop, [(c, "K") for c in range(7)], lines)
    assert [code for _, code in rows(result.outcomes, "cart_id", "code")] == ["OK", "LINE_UNAVAILABLE"] * 3 + ["OK"]
    assert len(result.rounds) == 1


def test_checkout_chains_of_all_kinds(spark):
    """Chains side by side, some with carts that have two rivals."""
    shop = Shop(TODAY, NOW)
    for i in range(32):
        shop.stock[str(20000000 + i)] = ["x", 1, TODAY, "Automat", "Kanal 1"]
    lines = [(c, n, str(20000000 + c + n)) for c in range(30) for n in range(2 + c % 2 * (c > 20)) if c + n < 32]
    check_out(spark, shop, [(c, "K") for c in range(30)], lines)


def test_checkout_long_chain(spark):
    """A chain of 2,000 carts, each waiting for the one before, is settled in one round."""
    shop = Shop(TODAY, NOW)
    stock = [(str(20000000 + i), "x", 1, TODAY, "Automat", "Kanal 1") for i in range(2001)]
    lines = [(c, n, str(20000000 + c + n)) for c in range(2000) for n in range(2)]
    result = Checkout(spark.createDataFrame(stock, S.STOCK), frames(spark, shop)["orders"],
                      spark.createDataFrame([(c, "K") for c in range(2000)], S.CARTS),
                      spark.createDataFrame(lines, S.CART_LINES), NOW)
    assert dict(rows(result.outcomes, "cart_id", "code")) == {c: "LINE_UNAVAILABLE" if c % 2 else "OK" for c in range(2000)}
    assert len(result.rounds) == 1


@pytest.mark.parametrize("seed", range(3))
def test_checkout_of_many_shops(spark, seed):
    """Seventy small shops at once: their carts do not meet, so each must come out as if alone."""
    rng, shop = random.Random(seed), Shop(TODAY, NOW)
    lines = []
    for place in range(70):
        first, goods = 20000000 + 100 * place, rng.randrange(2, 14)
        for i in range(goods):
            shop.stock[str(first + i)] = ["x", 1, TODAY, "Automat", "Kanal 1"]
        for c in range(rng.randrange(1, 12)):
            wanted = rng.sample(range(goods), min(goods, rng.choice([1, 2, 2, 3])))
            lines += [(12 * place + c, n, str(first + i)) for n, i in enumerate(wanted)]
    check_out(spark, shop, [(c, "K") for c in sorted({line[0] for line in lines})], lines)


def test_checkout_of_nothing(spark):
    shop = Shop(TODAY, NOW)
    result = check_out(spark, shop, [(1, "K"), (2, "")], [(1, 1, "12345678")])
    assert rows(result.outcomes, "code") == [("LINE_UNAVAILABLE",), ("NO_CUSTOMER",)]


def test_checkout_hot_barcode_and_large_cart(spark):
    """One barcode that a third of all lines name, one cart that holds another third."""
    shop = Shop(TODAY, NOW)
    for i in range(400):
        shop.stock[str(20000000 + i)] = ["x", 1, TODAY, "Automat", "Kanal 1"]
    lines = [(c, 0, "20000000") for c in range(2, 202)] + [(1, n, str(20000000 + n)) for n in range(200)]
    lines += [(c, 1, str(20000100 + c)) for c in range(2, 202)]
    check_out(spark, shop, [(c, "K") for c in range(1, 203)], lines)


@pytest.mark.parametrize("seed", SEEDS)
def test_cancellation(spark, seed):
    rng, shop = a_shop(seed)
    before = frames(spark, shop)
    requests = [(i, rng.choice([None, 0]) if rng.random() < 0.1 else 100000 + rng.randrange(22),
                 rng.choice(["", None, "K0", "K1", "K2"])) for i in rng.sample(range(1000), 120)]
    result = Cancellation(before["stock"], before["orders"], spark.createDataFrame(requests, S.CANCEL_REQUESTS), TODAY)
    expected = [(seq, *shop.cancel(g, k)) for seq, g, k in sorted(requests, key=lambda r: r[0])]
    assert rows(result.outcomes, "seq", "code", "detail") == sorted(expected, key=repr)
    same_stock(result.stock, shop)
    same_orders(result.orders, shop)
    assert {code for _, code, _ in expected} == {"OK", "MISSING_ARG", "NOT_OPEN", "CONFLICT"}


@pytest.mark.parametrize("seed", SEEDS)
def test_status(spark, seed):
    rng, shop = a_shop(seed)
    orders = frames(spark, shop)["orders"]
    requests = [(i, 100000 + rng.randrange(25), rng.choice(S.STATUSES)) for i in rng.sample(range(100), 15)]
    result = set_order_status(orders, spark.createDataFrame(requests, S.STATUS_REQUESTS))
    for _, group, status in sorted(requests):
        shop.set_status(group, status)
    same_orders(result, shop)


@pytest.mark.parametrize("seed", SEEDS)
def test_registration(spark, seed):
    rng, shop = a_shop(seed)
    if seed % 2:
        shop.users["chef"] = [99, "10000003", "admin"]
    users = frames(spark, shop)["users"]
    requests = [(i, rng.choice(["", None]) if rng.random() < 0.1 else f"user {rng.randrange(30)}", rng.choice(["user", None]))
                for i in rng.sample(range(1000), 60)]
    if seed == 2:
        shop.orders.append([61, 100099, "10000777", "10000001", "x", NOW, "Offen"])
    result = Registration(users, spark.createDataFrame(requests, S.USER_REQUESTS), frames(spark, shop)["orders"])
    expected = [(seq, *shop.register(n, role)) for seq, n, role in sorted(requests, key=lambda r: r[0])]
    assert rows(result.outcomes, "seq", "code", "detail") == sorted(expected, key=repr)
    after = [(u[0], u[1], n, u[2]) for n, u in shop.users.items()]
    assert rows(result.users, *S.USERS.names) == sorted(after, key=repr)
    assert not rows(remove_users(result.users, result.users))


def test_numbers_are_not_given_again(spark):
    """Whoever registers after a customer has left gets neither the number nor the id."""
    users = spark.createDataFrame([(1, "10000000", "chef", "admin"), (2, "10000001", "anna", "user")], S.USERS)
    orders = spark.createDataFrame([(1, 100000, "10000001", "12345678", "x", NOW, "Offen")], S.ORDERS)
    left = remove_users(users, spark.createDataFrame([("anna",)], "username string"))
    bert = spark.createDataFrame([(1, "bert", None)], S.USER_REQUESTS)
    assert rows(Registration(left, bert, orders, last_id=2).new_users) == [(3, "10000002", "bert", "user")]
    assert rows(Registration(left, bert, last_number=10000001, last_id=2).new_users) == [(3, "10000002", "bert", "user")]


@pytest.mark.parametrize("seed", SEEDS)
def test_warnings(spark, seed):
    _, shop = a_shop(seed)
    before = frames(spark, shop)
    shop.refresh_warnings()
    result = refresh_warnings(before["warnings"], before["stock"], TODAY)
    assert rows(result, *S.WARNINGS.names) == sorted(((b, *w) for b, w in shop.warnings.items()), key=repr)
