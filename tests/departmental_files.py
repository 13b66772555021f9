"""Small departmental source files with the traps of real ones: CRLF line ends,
a quoted comma, ``NA`` cells, a trailing blank, stored Total rows, a district
given twice, a tie for the best sector, a month without grievances."""

import json
import os

ITEMS = """Section,Item,Target,Current Status,Percentage Achieved,Budget Allocated,Budget Utilized
Roads,Bridge A,"10 km, paved",6 km,60,100.5,50.25
Roads,Bridge B,5,5,100,20.0,20.0
E-Enablement,E-Office Implementation,100%,80%,80,10.0,5.0
Water,Wells,NA,12,25,40.0,0.0
"""
SECTORS = """Sector,Budget_Allocation,Budget_Utilization,Projects_Count,Beneficiaries,Implementation_Percentage
E-Governance,100.00,50.00,4,1000,70
Health,200.00,150.00,6,NA,90
Roads,100.00,50.00,5,3000,90
Total,400.00,250.00,15,4000,83\x20
"""
MONTHS = """Month,Budget_Allocation,Budget_Utilization,Grievances_Received,Grievances_Resolved,\
ProjectsCompleted,NewProjectsStarted,TrainingSessions,OnlineServiceHits
Apr-2023,10,5,10,9,1,2,3,100
May-2023,20,15,20,20,2,1,4,200
Jun-2023,30,0,0,0,3,3,5,300
Total,60,20,30,29,6,6,12,600
"""
DISTRICTS = """District,Budget_Allocation,Budget_Utilization,Projects_Count,Implementation_Percentage,\
Population_Covered,Grievances_Resolved
North,50.00,25.00,3,50,1000,5
South,30.00,30.00,2,60,2000,6
North,50.00,45.00,1,80,3000,7
East,20.00,0.00,1,90,4000,8
"""
DOCUMENT = {"Office": {"Contact": {"Site": "www.example.org"}, "Staff": 12},
            "Grants": {"Roads": {"Funds": "Rs. 163.98 Cr", "Done": "70%"}},
            "Notes": ["note number %d" % i for i in range(60)]}
FILES = {"SampleTabularData.csv": ITEMS, "SectoralDistribution.csv": SECTORS, "TimeSeriesData.csv": MONTHS,
         "DistrictData.csv": DISTRICTS, "SampleTextUnstructuredData.txt": "  Bridges were built.\nWells were dug. \n",
         "SampleJSONData.json": json.dumps(DOCUMENT, indent=2)}


def write(folder, changes: dict[str, str | None] | None = None) -> str:
    """The six files in ``folder``; ``changes`` replaces some or leaves them out (None)."""
    for name, text in {**FILES, **(changes or {})}.items():
        if text is not None:
            with open(os.path.join(folder, name), "w", encoding="utf-8", newline="") as f:
                f.write(text.replace("\n", "\r\n") if name.endswith(".csv") else text)
    return str(folder)
