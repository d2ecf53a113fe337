"""Declared schemas; nothing is ever inferred.

A document's schema names only what is read, and values that are merely carried come as text: an odd value there must
not cost the document.
"""

from __future__ import annotations

import re


def ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in columns.items())


def _columns(text: str) -> dict[str, str]:
    return dict(c.split() for c in text.replace("\n", " ").split(","))


DOCUMENT = """
meta struct<data_version:string>,
info struct<
  season:string, dates:array<string>, venue:string, city:string, teams:array<string>,
  toss:struct<winner:string, decision:string>,
  outcome:struct<winner:string, result:string, by:struct<runs:string, wickets:string>>,
  event:struct<name:string, match_number:string>,
  officials:struct<umpires:array<string>>,
  player_of_match:array<string>, match_type:string, overs:string, balls_per_over:string>,
innings array<struct<
  team:string,
  powerplays:array<struct<`from`:double, `to`:double>>,
  overs:array<struct<
    `over`:int,
    deliveries:array<struct<
      batter:string, bowler:string, non_striker:string,
      runs:struct<batter:int, extras:int, total:int>,
      extras:struct<wides:int, noballs:int, legbyes:int, byes:int, penalty:int>,
      wickets:array<struct<kind:string, player_out:string, fielders:array<struct<name:string>>>>>>>>>>
"""

#: A list of documents, a mark behind it, and what was wrong.
DOCUMENTS_WITH_ERRORS = f"documents array<struct<{re.sub(r'(\w+) (struct|array)<', r'\1:\2<', DOCUMENT)}>>, read_to_here boolean, _corrupt_record string"

# The columns of the base tables.
MATCHES = _columns("""
match_id string, season string, date date, venue string, city string, team1 string, team2 string,
toss_winner string, toss_decision string,
innings1_team string, innings1_runs int, innings1_wickets int,
innings2_team string, innings2_runs int, innings2_wickets int,
winner string, win_by_runs int, win_by_wickets int, player_of_match string,
umpire1 string, umpire2 string, match_number int, event_name string, match_type string,
overs int, balls_per_over int, data_version string
""")

DELIVERIES = _columns("""
match_id string, innings int, batting_team string, bowling_team string, over int, ball int,
batter string, non_striker string, bowler string, batter_runs int, extras int, total_runs int,
wides int, noballs int, legbyes int, byes int, penalty int,
is_wicket int, wicket_kind string, player_out string, fielder string,
cumulative_runs bigint, cumulative_wickets bigint, in_powerplay int
""")
