"""Recorded answers for tests of transports: a stand-in for fetching pages."""

import json

ASKED = []
OAI = '<OAI-PMH xmlns="http://www.openarchives.org/OAI/2.0/">{}</OAI-PMH>'
RECORD = '<record><header{}/><metadata><arXiv xmlns="http://arxiv.org/OAI/arXiv/"><id>{}</id><title>T</title><authors><author><keyname>Li</keyname><forenames>B</forenames></author></authors></arXiv></metadata></record>'


def get(url, params=None):
    ASKED.append((url, params))
    if "openalex" in url:
        if params["filter"].startswith("doi:"):
            return json.dumps({"results": [{"id": d} for d in params["filter"][4:].split("|")]})
        at = {"*": 0, "c1": 1}[params["cursor"]]
        return json.dumps({"results": [{"id": f"W{at}"}, {}], "meta": {"next_cursor": "c1" if at == 0 else "c1"}})
    if "oai" in url:
        if params.get("set") == "none":
            return OAI.format('<error code="noRecordsMatch"/>')
        if params.get("set") == "bad":
            return OAI.format('<error code="badArgument">no</error>')
        if "resumptionToken" in params:
            return OAI.format(f"<ListRecords>{RECORD.format('', '2401.2')}<resumptionToken/></ListRecords>")
        return OAI.format(f"<ListRecords>{RECORD.format('', '2401.1')}{RECORD.format(' status=\"deleted\"', '2401.9')}<resumptionToken>tok</resumptionToken></ListRecords>")
    if "biorxiv" in url:
        at = int(url.rsplit("/", 1)[1])
        if "/pubs/" in url:
            return json.dumps({"messages": [{}], "collection": [{"preprint_doi": " a ", "published_doi": "b"}, {"preprint_doi": "c"}]})
        return json.dumps({"messages": [{"total": "3"}], "collection": [{"doi": f"d{i}", "version": "2"} for i in range(at, min(at + 2, 3))]})
    mark = params["cursorMark"]
    return json.dumps({"resultList": {"result": [{"id": mark, "source": "MED"}, {"id": "x"}]}, "nextCursorMark": "m2" if mark == "*" else mark})
