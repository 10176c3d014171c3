"""Readers of dirty values in SQL."""


def item_sql(c: str = "item_id") -> str:
    exponent = f"cast(cast(try_cast(regexp_extract({c}, '[0-9.]+[eE][+-]?[0-9]+') as double) as hugeint) as varchar)"
    plain = f"regexp_replace(regexp_replace(regexp_extract({c}, '[0-9][0-9.,]*'), '[.,][0-9]{{1,2}}$', ''), '[^0-9]', '', 'g')"
    return f"(case when {c} is null or not regexp_matches({c}, '[0-9]') then null when regexp_matches({c}, '[0-9][eE][+-]?[0-9]') then {exponent} else coalesce(nullif(ltrim({plain}, '0'), ''), '0') end)"


def price_sql(c: str = "price") -> str:
    return f"(case when regexp_matches({c}, '-[^0-9A-Za-z]*[0-9]') then -1 else 1 end * cast({item_sql(c)} as bigint))"


def type_sql(c: str = "event_type") -> str:
    return f"trim(regexp_replace(lower({c}), '[^0-9a-z]+', '_', 'g'), '_')"
