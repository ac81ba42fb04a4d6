from sieveworks.config import ContextConfig, ScoringConfig


def test_lenient():
    assert ScoringConfig.from_dict(None) == ScoringConfig.from_dict([1]) == ScoringConfig()
    read = ScoringConfig.from_dict({"recency_boost_max": "1", "recency_half_life_days": -1, "language": 5, "phrase_near_window": 7.5, "title_match_boost": 2, "custom_stop_words": ["a", 1], "recency_curve": [[1, 2], [3]]})
    assert read == ScoringConfig(title_match_boost=2.0)
    assert ScoringConfig.from_dict({"recency_half_life_days": 2**32 + 5}).recency_half_life_days == 5
    assert ScoringConfig.from_dict({"priority_pages": [{"url_pattern": "a", "keywords": ["b"], "boost": 1}, {"url_pattern": "a"}]}).priority_pages == ()
    assert ContextConfig.from_dict({"max_length": 5, "separator": 1}) == ContextConfig(max_length=5)


def test_clamp():
    config, warnings = ScoringConfig.from_dict_validated({"recency_boost_max": 10.0, "results_per_page": 0})
    assert (config.recency_boost_max, config.results_per_page) == (2.0, 1) and [w.field for w in warnings] == ["recency_boost_max", "results_per_page"]
    assert warnings[0].message == "10.0 is not within 0.0 to 2.0; 2 is used" and ScoringConfig().warnings() == []
    odd = ScoringConfig(recency_strategy="custom"), ScoringConfig(recency_strategy="x"), ScoringConfig(recency_curve=((2.0, 1.0), (1.0, 1.0)))
    assert [[w.field for w in c.warnings()] for c in odd] == [["recency_curve"], ["recency_strategy"], ["recency_curve"]]
