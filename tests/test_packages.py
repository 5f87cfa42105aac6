"""Kinds of small table sets, by what their columns share."""

import pytest

from tabwright.operators import packages, profile
from tabwright.sources.scratch import Steps

NATIONS = ["挪威", "德国", "中国", "美国", "法国"]
MEDALS = (["国家", "金牌"], [[n, str(9 - i)] for i, n in enumerate(NATIONS)])
RANKED = (["名次", "国家"], [[str(i + 1), n] for i, n in enumerate(NATIONS)])
MEN = (["运动员", "国家", "成绩数"], [[f"运动员{x}", NATIONS[i % 5], str(i)] for i, x in enumerate("甲乙丙丁戊己")])
GROUPS = (["国家", "大洲"], [["挪威", "欧洲"], ["德国", "欧洲"], ["法国", "欧洲"], ["中国", "其他洲"], ["美国", "其他洲"]])
PLACES = (["大洲", "人口数"], [["欧洲", "7"], ["其他洲", "40"], ["南极洲", "1"]])
OTHERS = (["国家", "金牌"], [["巴西", "1"], ["印度", "2"], ["日本", "3"]])
SETS = {
    "single": [MEDALS], "category_decomp": [GROUPS], "period_pair": [(MEDALS, 2016), (MEDALS, 2020)], "split_pair": [MEDALS, OTHERS], "rank_detail": [MEN, RANKED],
    "join_filter": [MEN, GROUPS], "category_partner": [GROUPS, PLACES], "bridge_chain": [MEN, GROUPS, PLACES], "hub_profile": [MEDALS, RANKED, MEN], "unrelated": [MEN, OTHERS],
}


@pytest.mark.parametrize("swapped", [False, True])
def test_kinds(spark, swapped):
    tables, members = [], []
    for kind, parts in SETS.items():
        for i, part in enumerate(reversed(parts) if swapped else parts):
            (headers, rows), period = part if isinstance(part[1], int) else (part, None)
            tables.append((f"{kind}{i}", headers, rows))
            members.append((kind, f"{kind}{i}", period))
    cells = profile.explode_tables(spark.createDataFrame(tables, "table_id string, headers array<string>, rows array<array<string>>"))
    with Steps(spark) as steps:
        found = packages.package_kinds(cells, spark.createDataFrame(members, "package_id string, table_id string, period int"), steps).collect()
    assert {r["package_id"]: r["kind"] for r in found} == {k: k for k in SETS}
    assert {r["package_id"]: r["n_tables"] for r in found} == {k: len(v) for k, v in SETS.items()}


def test_values_of_columns_are_of_distinct_texts(spark):
    rows = [["挪威队", "1"], ["挪威队", "1"], ["挪威", " "], [" 挪威 ", None]] * 3
    cells = profile.explode_tables(spark.createDataFrame([("t", ["国家", "金牌"], rows)], "table_id string, headers array<string>, rows array<array<string>>"))
    assert {tuple(r) for r in packages.column_values(cells).collect()} == {("t", 0, "挪威"), ("t", 1, "1")}
    assert packages.column_values(cells).count() == 2
