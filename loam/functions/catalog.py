"""The built-in metric catalogue."""

from __future__ import annotations

#: Id | name | unit | priority | aliases; words that tell it from its neighbours.
ENTRIES = """
click_through_rate | Click Through Rate | percent | 3 | CTR, click-through rate, click through rate | click, through
view_through_rate | View Through Rate | percent | 3 | VTR, view-through rate, view through rate | view, through
video_completion_rate | Video Completion Rate | percent | 2 | VCR, video completion rate, completion rate | completion, complete, video
conversion_rate | Conversion Rate | percent | 3 | CVR, conversion rate | conversion, convert
cost_per_acquisition | Cost per Acquisition | currency | 3 | CPA, cost per acquisition, cost per acquired user | acquisition, acquired
cost_per_install | Cost per Install | currency | 3 | CPI, cost per install | install
cost_per_engagement | Cost per Engagement | currency | 3 | CPE, cost per engagement | engagement
cost_per_click | Cost per Click | currency | 3 | CPC, cost per click | click
cost_per_mille | Cost per Mille | currency | 3 | CPM, cost per mille, cost per thousand | mille, thousand
cost_per_view | Cost per View | currency | 3 | CPV, cost per view | view
install_rate | Install Rate | percent | 2 | install rate |
launch_rate | Launch Rate | percent | 2 | launch rate |
install_lift | Install Lift | percent | 2 | install lift | lift, install
launch_lift | Launch Lift | percent | 2 | launch lift | lift, launch
roas | Return on Ad Spend | ratio | 3 | ROAS, return on ad spend | return, spend
roi | Return on Investment | percent | 3 | ROI, return on investment | return, investment
installs | Installs | count | 2 | install, installs, total installs |
launches | Launches | count | 2 | launches, launch, total launches |
unique_reach | Unique Reach | count | 3 | unique reach, deduplicated reach, de-duplicated reach, unduplicated reach | unique, deduplicated, unduplicated
monthly_active_users | Monthly Active Users | count | 2 | MAU, monthly active users |
daily_active_users | Daily Active Users | count | 2 | DAU, daily active users |
reach | Reach | count | 1 | reach |
household_reach | Household Reach | count | 2 | household reach, hh reach | household, hh
share_of_voice | Share of Voice | percent | 2 | share of voice, SOV | voice, share
grps | GRPs | count | 2 | GRP, GRPs, gross rating point, gross rating points | rating, gross
trps | TRPs | count | 2 | TRP, TRPs, target rating point, target rating points | rating, target
impressions | Impressions | count | 2 | impression, impressions |
clicks | Clicks | count | 2 | click, clicks |
views | Views | count | 2 | view, views, video views |
completes | Completes | count | 2 | complete, completes, video completion, video completions |
investment | Investment | currency | 2 | investment, total investment |
spend | Spend | currency | 2 | spend, spending, total spend |
csrb_spend | Content Store Roadblock Spend | currency | 1 | CSRB, content store roadblock, content store rb |
acquisitions | Acquisitions | count | 2 | acquisitions, acquired users, acquired user |
qualified_acquisitions | Qualified Acquisitions | count | 2 | qualified acquisitions, qualified acquired users, qualified acquired user | qualified
conversions | Conversions | count | 2 | conversions, converted users, converted user |
purchases | Purchases | count | 2 | purchases, purchase, transactions, transaction |
sign_ups | Sign-ups | count | 2 | sign up, sign-up, signups, sign ups, sign-in, sign in |
leads | Leads | count | 2 | lead, leads |
engagements | Engagements | count | 2 | engagement, engagements, engaged users, engaged user |
sessions | Sessions | count | 2 | session, sessions, session count |
avg_session_duration | Average Session Duration | time | 2 | avg session duration, average session duration, session duration, duration per session, avg duration per session, average duration per session |
frequency | Frequency | count | 1 | frequency, freq, avg monthly freq, avg monthly frequency, average monthly frequency, monthly freq, monthly frequency |
video_starts | Video Starts | count | 2 | video starts, video start |
fill_rate | Fill Rate | percent | 2 | fill rate |
win_rate | Win Rate | percent | 2 | win rate |
viewability | Viewability | percent | 2 | viewability |
"""


def entries() -> list[tuple]:
    """(metric_id, name, unit, priority, aliases, disambiguation)."""
    out = []
    for line in ENTRIES.strip().splitlines():
        parts = [x.strip() for x in line.split("|")]
        words = lambda t: [w.strip() for w in t.split(",") if w.strip()]
        out.append((parts[0], parts[1], parts[2], int(parts[3]), words(parts[4]), words(parts[5])))
    return out


def frame(spark):
    return spark.createDataFrame(entries(), "metric_id string, name string, unit string, priority int, aliases array<string>, disambiguation array<string>")


def aliases(spark):
    from pyspark.sql import functions as F

    return frame(spark).select("metric_id", "name", "unit", "priority", F.explode("aliases").alias("alias"))
