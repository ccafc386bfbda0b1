"""Leaks that are changed inside, and items that templates say little about."""

from tests.llm.test_operators import leak_rows

LONG = "the farmer took the cart to the mill and sold 500 sacks of corn to a man who had come from the town over the hill that day"
NAMED = "in the morning the old man and his friend Tom walked to the river and sat down under the big tree to wait for the boat home"
SPELT = "there were some birds on the roof of the house and thirty more came down from the sky before the rain began to fall on the garden"


def test_op7_decontaminate_finds_changes_of_length(spark):
    items = (LONG, NAMED, SPELT)
    texts = [
        LONG.replace("500", "1,500"), LONG.replace("500", "2.5"), NAMED.replace("Tom", "Mary Ann"), SPELT.replace("thirty", "twenty-five"), SPELT.replace("thirty", "one hundred and five"),
        LONG.replace("corn", "yellow corn"), "so then " + LONG.replace("sold", "gladly sold") + " and more",
    ]
    got = leak_rows(spark, texts, items)
    assert {k: v.item_id for k, v in got.items()} == {0: 0, 1: 0, 2: 1, 3: 2, 4: 2, 5: 0, 6: 0}
    assert [got[k].kind for k in range(5)] == ["re-parameterised"] * 5 and got[5].kind == "verbatim"


def test_op7_decontaminate_finds_one_changed_word(spark):
    item = " ".join(LONG.split()[:25])
    assert set(leak_rows(spark, [item.replace("sacks", "bags"), " ".join(item.split()[:12])], (item,))) == {0}


def test_op7_decontaminate_knows_all_number_words_and_units(spark):
    item = "she ran two meters and then three more before the bell rang"
    texts = [f"she ran {n} {u} and then {m} more before the bell rang" for n, m, u in (("thirteen", "zero", "kilograms"), ("ninety", "billion", "meters"), ("sixty", "nineteen", "pints"))]
    assert {k: v.kind for k, v in leak_rows(spark, texts, (item,)).items()} == dict.fromkeys(range(3), "re-parameterised")


def test_op7_decontaminate_finds_every_item_verbatim(spark):
    items = ("What is 12 + 7 * 3 - 4?", "12 * 7 = 84", "小明有十二个苹果,他给了小红五个苹果,请问他还剩下几个苹果?", "今天天气好", "?!?!", "cat Zürich", None, " \n")
    texts = [f"so now we are asked {items[0]} and then some", "3 + 4, 12*7=84, 5", f"问题:{items[2]}答案", "昨天说今天天气好吗", "what ?!?!", "my CAT zürich", "What is 13 + 7 * 3 - 4?", "今天天气坏", "cat", ""]
    assert {k: v.item_id for k, v in leak_rows(spark, texts, items).items()} == dict(enumerate(range(6)))
