import glob
import os
import re

from hrefsieve.__main__ import RAW, run
from tests.test_discovery import SITE, docs_of
from tests.test_report_and_io import read_csv


def test_command_line_runs(spark, tmp_path):
    documents = {**SITE, "https://h.com/1": '<a href="/go">x</a> target.example', "https://w.h.com/3": "<p>nothing"}
    docs_of(spark, documents).select(*RAW).write.parquet(str(tmp_path / "landed"))
    (tmp_path / "in.csv").write_text("target.example\n\nabsent.example\n")
    common = ["--pages", str(tmp_path / "landed"), "--input", str(tmp_path / "in.csv"), "--output", str(tmp_path / "out.csv"), "--domains", "h.com"]

    full = run(spark, common + ["--max-pages", "50", "--concurrency", "4"], "S1")
    assert sorted(os.listdir(full)) == [
        "discovered_pages_S1.txt", "discovered_sitemaps_all_S1.txt", "discovered_sitemaps_initial_S1.txt", "out_S1.csv", "report_S1.parquet", "run_summary_S1.json", "scanned_pages_S1.csv",
    ]
    report = read_csv(f"{full}/out_S1.csv")
    assert len(report[0]) == 103 and [r[:4] for r in report[1:]] == [["target.example", "true", "1", "https://h.com/1"], ["absent.example", "false", "0", ""]]
    assert sorted(r[0] for r in read_csv(f"{full}/scanned_pages_S1.csv")[1:]) == ["https://h.com/1", "https://w.h.com/3"]
    listed = [x for p in sorted(glob.glob(f"{full}/discovered_sitemaps_all_S1.txt/part-*")) for x in open(p).read().splitlines()]
    assert len(listed) == 7 and listed == sorted(listed)

    summary = [x for p in glob.glob(f"{full}/run_summary_S1.json/part-*") for x in open(p).read().splitlines()]
    assert len(summary) == 1 and '"inputs_matched":1' in summary[0] and '"page_budget_reached":false' in summary[0]

    other = run(spark, common + ["--max-pages", "1", "--link-mode", "regex", "--loc-mode", "regex", "--encode-mode", "uri", "--no-robots", "--longest-robots-match", "--schemes", "https"], "S4")
    assert '"page_budget_reached":true' in "".join(open(p).read() for p in glob.glob(f"{other}/run_summary_S4.json/part-*"))

    crawl = run(spark, common + ["--ignore-inputs"], "S2")
    assert "scanned_pages_S2.csv" in os.listdir(crawl) and not glob.glob(f"{crawl}/out*")

    (tmp_path / "domains.txt").write_text("other.example\n h.com \n\n")
    listed = run(spark, ["--pages", str(tmp_path / "landed"), "--input", str(tmp_path / "in.csv"), "--output", str(tmp_path / "out.csv"), "--domain-list", str(tmp_path / "domains.txt"),
                         "--match-strategy", "windows", "--min-variant-length", "7", "--quote-all", "--utc-stamp"])
    stamp = listed.rsplit("output_", 1)[1]
    assert re.fullmatch(r"\d{8}T\d{6}", stamp) and read_csv(f"{listed}/out_{stamp}.csv") == report
    assert all(open(p).read().startswith('"queried_url"') for p in glob.glob(f"{listed}/out_{stamp}.csv/part-*") if os.path.getsize(p))

    check = run(spark, common + ["--test-url", "https://h.com/1", "--no-body"], "S3")
    assert read_csv(f"{check}/test_results_S3.csv") == [["queried_url", "found", "match_count", "match_page_1"], ["target.example", "false", "0", ""], ["absent.example", "false", "0", ""]]

    from hrefsieve.session import checkpoint_dir, remove_scratch

    remove_scratch(spark)
    assert not [x for x in os.listdir(checkpoint_dir(spark).removeprefix("file:")) if re.search("-[0-9a-f]{32}$", x)]
