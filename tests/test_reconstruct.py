import random

import pytest

from cellwright.operators import reconstruct as rc, rows

BOATS = rc.RecordSpec(
    ("Hull_No", "Skipper_Given", "Skipper_Family", "Years_Old", "Sex", "Berth", "Launched", "Mooring_Fee"),
    ("id", "first_name", "last_name", "age", "gender", "text", "date", "currency"),
)
SEEDS = rc.RecordSpec(("Lot", "Grower", "Field", "Sown", "Price"), ("id", "name", "text", "date", "currency"))
CHOIR = rc.RecordSpec(("Given", "Family", "Stage", "Voice"), ("first_name", "last_name", "name", "categorical"))


def random_lines(rng, spec, n):
    values = {
        "id": ["530", "8", "k", ""], "first_name": ["Wanda", "", "W7"], "last_name": ["Osei", ""], "name": ["P Q", ""],
        "age": ["41", "37 *", "old", ""], "gender": ["f", "M", "z", ""], "text": ["Pier", ""], "categorical": ["alto", ""],
        "date": ["2018-09-14", "NA", "7.3.19", "never"], "currency": ["$2,350", "NA", "9y", "$ 8"],
    }
    out = []
    for _ in range(n):
        if rng.random() < 0.12:
            out.append(" | ".join(rng.choice(values[t]) for t in spec.column_semantics))
        else:
            header = " | ".join(spec.target_columns).replace("_", " ")
            out.append(
                rng.choice(
                    [header, "", "rain on the roof", "|", "3 | c | ", "| c", "Ekdal", "Bo", "66", "Tuva Moe", "66 Moe", "Tuva | Moe", "Harbour", "xy"]
                )
            )
    return out


def rebuilt(df, spec):
    out, report = rc.reconstruct(df, spec)
    r = report.first()
    return [tuple(x)[1:] for x in out.orderBy("_row").collect()], (r["rows_parsed"], r["rows_dropped"], r["duplicates_removed"], r["output_rows"])


def test_boats_by_hand(table):
    """A family name for the record before, a pending id that gets both names, a header, noise and a repeat."""
    lines = [
        "530 | Wanda |  | 41 | F | Pier Three | 2018-09-14 | $2,350",
        "Osei",
        "531 | Ravi | Blom | 37* | z | Quay | NA | NA",  # gender 0.1, currency 0.05
        "8",  # no open slot in the record before
        "Tuva Ekdal",  # id 0.15, age 0.05, gender 0.05, currency 0.05
        "",
        "Hull No | Skipper Given | Skipper Family | Years Old",
        "531 | ravi | BLOM | 37 | z | quay |  | ",
    ]
    rows_, totals = rebuilt(table(["blob"], [(x,) for x in lines]), BOATS)
    assert [r[:-1] for r in rows_] == [
        ("530", "Wanda", "Osei", "41", "F", "Pier Three", "2018-09-14", "2350"),
        ("531", "Ravi", "Blom", "37", "z", "Quay", "", ""),
        ("8", "Tuva", "Ekdal", "", "", "", "", ""),
    ]
    assert [r[-1] for r in rows_] == pytest.approx([1.0, 0.85, 0.7])
    assert totals == (4, 3, 1, 3)


def test_seeds_by_hand(table):
    """A short token finds no slot, the next pending record replaces the one before, two tokens fill one name."""
    lines = ["19 | Io Wu | North | 2021-04-30 | 7", "Clay", "66", "Bo Hahn"]
    rows_, totals = rebuilt(table(["blob"], [(x,) for x in lines]), SEEDS)
    assert [r[:-1] for r in rows_] == [("19", "Io Wu", "North", "2021-04-30", "7"), ("66", "Bo Hahn", "", "", "")]
    assert [r[-1] for r in rows_] == pytest.approx([1.0, 0.95])
    assert totals == (2, 2, 0, 2)


@pytest.mark.parametrize("spec", [BOATS, SEEDS, CHOIR])
def test_slices_and_partitions_change_nothing(table, monkeypatch, spec):
    """Slices of 8 rows force the state through many slices and super-slices."""
    lines = random_lines(random.Random(len(spec.target_columns)), spec, 500)
    whole = rebuilt(table(["blob"], [(x,) for x in lines]), spec)
    for module in (rc, rows):
        monkeypatch.setattr(module, "SLICE_BITS", 3)
    assert rebuilt(table(["blob"], [(x,) for x in lines]).repartition(5), spec) == whole
    parsed, dropped, repeats, out = whole[1]
    assert parsed - repeats == out == len(whole[0]) and parsed + dropped <= len(lines)


def test_noise_between_lines_changes_nothing(table):
    lines = random_lines(random.Random(4), BOATS, 120)
    noisy = [x for line in lines for x in (line, "", "rain on the roof")]
    assert rebuilt(table(["blob"], [(x,) for x in noisy]), BOATS)[0] == rebuilt(table(["blob"], [(x,) for x in lines]), BOATS)[0]


def test_partial_line_completes_the_record_before(table):
    given, repeat = ("612 | {} |  | 58 | M | Slip Four | 2016-02-11 | $480", "612 | {} | HOLT | 58 | M | Slip Four | 2016-02-11 | $480")
    t = table(["blob"], [(given.format("Pim"),), ("Holt",), (repeat.format("pim"),)])
    out, report = rc.reconstruct(t, BOATS)
    assert out.count() == 1 and out.first()["Skipper_Family"] == "Holt" and out.first()["Mooring_Fee"] == "480"
    assert report.first()["duplicates_removed"] == 1


def test_line_kinds(table):
    full, header = "530 | Wanda | Osei | 41 | F | Pier | 2018-09-14 | $8", "Hull No | Skipper Given | Skipper Family | Years Old"
    t = table(["a", "b"], [("note", full), (header, ""), ("Ekdal", None), (" ", "")])
    got = [(r["kind"], r["parts"]) for r in rc.classify(t, BOATS).orderBy("row").collect()]
    assert [k for k, _ in got] == ["FULL_RECORD", "HEADER", "PARTIAL_RECORD", "NOISE"]
    assert got[0][1][0] == "530" and got[2][1] == ["Ekdal"]


def test_skips(table):
    tabular = table(list(BOATS.target_columns), [("2", "Lev", "Sand", "33", "M", "Quay", "2022-08-05", "640")])
    for spec, reason in ((BOATS, None), (None, "no_reconstruction_spec")):
        out, report = rc.reconstruct(tabular, spec)
        r = report.first()
        assert out.columns == tabular.columns and r["skipped"] and r["reason"] == reason and r["output_rows"] == 1
    assert rc.reconstruct(tabular.where("false"), BOATS)[1].first()["output_rows"] == 0


@pytest.mark.parametrize("columns, tags", [(("a", "a"), ("id", "id")), (("a",), ("colour",)), (("a", "b"), ("id",)), (("a",), ("id", "text"))])
def test_specifications_that_make_no_sense(columns, tags):
    with pytest.raises(ValueError):
        rc.RecordSpec(columns, tags)
    with pytest.raises(ValueError):
        rc.RecordSpec(("a",), ("id",), "")
