import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

ROWS = {
    "a_hobby_frequency": 5, "b_top_pages_events": 10, "b_top_pages_orders": 10, "c_users_by_hobby": 34,
    "d_followers_part": 150, "d_followers_supp": 150, "e_activity_events": 149, "e_activity_orders": 149,
    "f_above_average_part": 67, "f_above_average_supp": 10, "f_above_average_part_allrows": 6,
    "g_outdated_orders": 98, "g_outdated_events_24h": 137, "h_one_way_part": 81, "h_one_way_supp": 45,
    "b_access_counts": 200, "b_counts_full_pages": 200, "d_follower_counts": 200, "f_avg_followers": 1,
    "g_global_max": 1, "g_user_max": 149, "h_same_region_edges_part": 156, "h_same_region_edges_supp": 66,
    "a_hobby_frequency_strict": 10, "a_hobby_frequency_lines": 5, "c_users_by_hobby_padded": 26, "text_pages": 132, "text_follows": 6000, "text_activity": 6000,
    "files_pages": 132, "files_page_count": 1, "files_follows": 6000, "files_activity": 6000, "files_d": 132, "files_e": 131, "files_h": 38,
    "h_one_way_ids_anti_part": 81, "h_one_way_ids_pair_part": 81, "h_one_way_ids_anti_supp": 45, "h_one_way_ids_pair_supp": 45,
}
SINK = {"a": 5, "b": 10, "c": 34, "d": 150, "e": 149, "f": 10, "g": 98, "h": 45}


@pytest.mark.parametrize("name", sorted(entry._graph_queries()))
def test_query_equals_sql(spark, sf_dir, name):
    df = entry._graph_queries()[name](spark, sf_dir)
    assert compare(df, entry._graph_sql()[name], connect(sf_dir)) == ROWS.get(name, SINK.get(name[-1]) if name.startswith("sink") else None)


def test_entry(spark):
    assert entry.entry(spark).count() == 81
    assert set(entry.oracle_sql()) <= set(entry.queries())
