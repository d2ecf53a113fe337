"""Fixed values.

These have to equal the published cricket data conventions for results to be
right, so they are stated here as plain tables.
"""

# Former franchise name -> present name.
TEAM_RENAMES = {
    "Kings XI Punjab": "Punjab Kings",
    "Delhi Daredevils": "Delhi Capitals",
    "Royal Challengers Bangalore": "Royal Challengers Bengaluru",
    "Rising Pune Supergiant": "Rising Pune Supergiants",
}

# Venue name as recorded -> canonical venue name.
VENUE_RENAMES = {
    "Arun Jaitley Stadium, Delhi": "Arun Jaitley Stadium",
    "Brabourne Stadium, Mumbai": "Brabourne Stadium",
    "Dr DY Patil Sports Academy, Mumbai": "Dr DY Patil Sports Academy",
    "Dr. Y.S. Rajasekhara Reddy ACA-VDCA Cricket Stadium, Visakhapatnam":
        "Dr. Y.S. Rajasekhara Reddy ACA-VDCA Cricket Stadium",
    "Eden Gardens, Kolkata": "Eden Gardens",
    "Himachal Pradesh Cricket Association Stadium, Dharamsala":
        "Himachal Pradesh Cricket Association Stadium",
    "M.Chinnaswamy Stadium": "M Chinnaswamy Stadium",
    "M Chinnaswamy Stadium, Bengaluru": "M Chinnaswamy Stadium",
    "MA Chidambaram Stadium, Chepauk": "MA Chidambaram Stadium",
    "MA Chidambaram Stadium, Chepauk, Chennai": "MA Chidambaram Stadium",
    "Maharaja Yadavindra Singh International Cricket Stadium, New Chandigarh":
        "Maharaja Yadavindra Singh International Cricket Stadium, Mullanpur",
    "Maharashtra Cricket Association Stadium, Pune": "Maharashtra Cricket Association Stadium",
    "Punjab Cricket Association IS Bindra Stadium, Mohali":
        "Punjab Cricket Association IS Bindra Stadium",
    "Punjab Cricket Association IS Bindra Stadium, Mohali, Chandigarh":
        "Punjab Cricket Association IS Bindra Stadium",
    "Punjab Cricket Association Stadium, Mohali": "Punjab Cricket Association IS Bindra Stadium",
    "Rajiv Gandhi International Stadium, Uppal": "Rajiv Gandhi International Stadium",
    "Rajiv Gandhi International Stadium, Uppal, Hyderabad": "Rajiv Gandhi International Stadium",
    "Sawai Mansingh Stadium, Jaipur": "Sawai Mansingh Stadium",
    "Vidarbha Cricket Association Stadium, Jamtha": "Vidarbha Cricket Association Stadium",
    "Wankhede Stadium, Mumbai": "Wankhede Stadium",
    "Feroz Shah Kotla": "Arun Jaitley Stadium",
    "Sardar Patel Stadium, Motera": "Narendra Modi Stadium, Ahmedabad",
}

# Franchise -> cities that count as home.
HOME_CITIES = {
    "Mumbai Indians": ["Mumbai"],
    "Chennai Super Kings": ["Chennai"],
    "Royal Challengers Bengaluru": ["Bangalore", "Bengaluru"],
    "Kolkata Knight Riders": ["Kolkata"],
    "Delhi Capitals": ["Delhi"],
    "Punjab Kings": ["Chandigarh", "Mohali", "Mullanpur"],
    "Rajasthan Royals": ["Jaipur"],
    "Sunrisers Hyderabad": ["Hyderabad"],
    "Lucknow Super Giants": ["Lucknow"],
    "Gujarat Titans": ["Ahmedabad"],
    "Deccan Chargers": ["Hyderabad"],
    "Kochi Tuskers Kerala": ["Kochi"],
    "Pune Warriors": ["Pune"],
    "Rising Pune Supergiants": ["Pune"],
    "Gujarat Lions": ["Rajkot", "Ahmedabad"],
}

# What a team is assumed to be before it has any history.
DEFAULT_RATE = 0.5
DEFAULT_POWERPLAY_RUNS = 45.0
DEFAULT_DEATH_WICKETS = 2.0
DEFAULT_BATTING_SR = 130.0
DEFAULT_BATTING_AVG = 25.0
DEFAULT_BOWLING_ECON = 8.5
DEFAULT_BOWLING_WKTS = 1.5

# Par score when nothing is known, and the spread of a score
# forecast without residual statistics.
DEFAULT_PAR = 167
DEFAULT_RESIDUAL_STD = 20.0

# First season of the twelve-player rule, and the date on which
# the held-out period starts.
TWELVE_PLAYER_ERA_FROM = 2023
HOLD_OUT_FROM = "2023-01-01"

# Over ranges (first, last) of an innings' phases.  Features and
# reports cut the innings differently.
FEATURE_PHASES = {"death": (17, 20), "mid": (7, 16)}
REPORT_PHASES = [("Powerplay", 1, 6), ("Middle", 7, 15), ("Death", 16, 20)]

# Left-closed target bands and right-closed scoring zones.
TARGET_BANDS = [
    ("100-119", 100, 120), ("120-139", 120, 140), ("140-159", 140, 160), ("160-179", 160, 180),
    ("180-199", 180, 200), ("200-219", 200, 220), ("220+", 220, 300),
]
SCORING_ZONES = [("dot", -1, 0), ("running", 0, 3), ("boundary", 3, 6)]

# The printed groups of match features.
FEATURE_GROUPS = {
    "Target / Result": ["target", "score_diff", "run_rate_inn1", "run_rate_inn2", "team1_won", "win_method"],
    "Toss": ["toss_winner_is_team1", "toss_bat_first", "toss_winner_batted"],
    "Powerplay": ["pp_runs_inn1", "pp_wickets_inn1", "pp_runs_inn2", "pp_wickets_inn2"],
    "Middle Overs": ["mid_runs_inn1", "mid_wickets_inn1", "mid_runs_inn2", "mid_wickets_inn2"],
    "Death Overs": ["death_runs_inn1", "death_wickets_inn1", "death_runs_inn2", "death_wickets_inn2"],
    "Boundaries": ["fours_inn1", "sixes_inn1", "dot_balls_inn1", "fours_inn2", "sixes_inn2", "dot_balls_inn2"],
    "Head-to-Head": ["h2h_matches", "h2h_team1_wins", "h2h_team1_win_rate"],
    "Venue": ["team1_venue_win_rate", "team2_venue_win_rate"],
    "Recent Form": ["team1_recent_form", "team2_recent_form"],
    "Bat-First Win Rate": ["team1_win_after_batting_first", "team2_win_after_batting_first"],
    "Avg Powerplay Runs": ["team1_avg_pp_runs", "team2_avg_pp_runs"],
    "Avg Death Wickets": ["team1_avg_death_wkts", "team2_avg_death_wkts"],
    "Home Advantage": ["is_home_team1", "is_home_team2"],
    "Season Progress": ["season_match_number", "season_progress"],
    "Impact Player Era": ["is_impact_player_era"],
}
