"""A hand-made six-table incident fixture; the answers in test_questions.py are worked
out by hand from these rows."""

UNITS_COLS = ["crash_id", "unit_nbr", "veh_lic_state_id", "vin", "veh_mod_year", "veh_make_id",
              "veh_color_id", "veh_body_styl_id", "veh_hnr_fl", "fin_resp_type_id",
              "veh_dmag_scl_1_id", "veh_dmag_scl_2_id", "contrib_factr_1_id", "contrib_factr_2_id",
              "contrib_factr_p1_id", "tot_injry_cnt", "death_cnt"]
UNITS = [
    (100, 1, "TX", "V1", "2010", "FORD", "BLK", "PASSENGER CAR, 4-DOOR", "N", "LIABILITY INSURANCE POLICY",
     "DAMAGED 5", "NA", "NONE", "NA", "NA", 1, 0),
    (100, 2, "TX", "V2", "2011", "FORD", "WHI", "PICKUP", "Y", "SURETY BOND",
     "NO DAMAGE", "NA", "UNDER INFLUENCE - ALCOHOL", "NA", "NA", 2, 1),
    (100, 3, "TX", "V3", "2012", "HONDA", "WHI", "MOTORCYCLE", "N", "PROOF OF LIABILITY INSURANCE",
     "DAMAGED 2", "DAMAGED 6", "NONE", "NA", "NA", 0, 0),
    (101, 1, "CA", "V4", "2009", "TOYOTA", "BLK", "PASSENGER CAR, 2-DOOR", "Y", "LIABILITY INSURANCE POLICY",
     "DAMAGED 7 HIGHEST", "NA", "HAD BEEN DRINKING", "NA", "NA", 3, 0),
    # same key as the row above, sorts after it: dropped by the dedup
    (101, 1, "CA", "V4", "2009", "TOYOTA", "BLK", "UNKNOWN", "Y", "LIABILITY INSURANCE POLICY",
     "DAMAGED 7 HIGHEST", "NA", "HAD BEEN DRINKING", "NA", "NA", 3, 0),
    (102, 1, "98", "V5", "NA", "HONDA", "99", "POLICE MOTORCYCLE", "N", "SURETY BOND",
     "INVALID VALUE", "NA", "NONE", "ALCOHOL", "NA", 1, 1),
    # the vehicle of (100, 1) again
    (103, 1, "TX", "V1", "2010", "FORD", "BLK", "PASSENGER CAR, 4-DOOR", "Y", "LIABILITY INSURANCE POLICY",
     "NA", "DAMAGED 5", "NONE", "NA", "NA", None, 0),
    (104, 1, "TX", "V6", "2015", "NISSAN", "GRY", "VAN", "N", "SURETY BOND",
     "NA", "NA", "NONE", "NA", "NA", 5, 0),
    (105, 1, "TX", "V7", "2016", "DODGE", "GRY", "VAN", "N", "SURETY BOND",
     "NA", "NA", "NONE", "NA", "NA", 0, 0),
]

PERSON_COLS = ["crash_id", "unit_nbr", "prsn_nbr", "prsn_type_id", "prsn_gndr_id", "prsn_injry_sev_id",
               "prsn_airbag_id", "prsn_ethnicity_id", "drvr_lic_cls_id", "drvr_lic_state_id", "drvr_zip",
               "prsn_alc_rslt_id", "tot_injry_cnt", "death_cnt"]
PERSONS = [
    (100, 1, 1, "DRIVER", "MALE", "KILLED", "NOT DEPLOYED", "WHITE", "CLASS C", "Texas", "78521", "NA", 0, 1),
    (100, 2, 1, "DRIVER", "Male", "KILLED", "DEPLOYED", "WHITE", "CLASS A", "Texas", "78521", "Positive", 0, 1),
    (100, 3, 1, "DRIVER OF MOTORCYCLE TYPE VEHICLE", "MALE", "KILLED", "NOT DEPLOYED", "BLACK",
     "OTHER/OUT OF STATE", "Texas", None, "NA", 0, 1),
    (101, 1, 1, "DRIVER", "FEMALE", "KILLED", "NOT DEPLOYED", "HISPANIC", "UNLICENSED", "California", "90001",
     "NA", 0, 1),
    (102, 1, 1, "DRIVER", "MALE", "NOT INJURED", "NOT DEPLOYED", "WHITE", "CLASS M", "NA", "UNKNOWN",
     "Positive", 0, 0),
    (103, 1, 1, "DRIVER", "MALE", "KILLED", "NOT DEPLOYED", "NA", "CLASS C", "Texas", "78521", "NA", 0, 1),
]

CHARGE_COLS = ["crash_id", "unit_nbr", "prsn_nbr", "charge"]
CHARGES = [
    (100, 1, 1, "SPEEDING"),
    # same person, sorts first: the dedup keeps it, and it is not a speeding charge
    (100, 1, 1, "ALCOHOL RELATED"),
    (100, 2, 1, "UNSAFE SPEED"),
    (100, 3, 1, "SPEEDING"),
    (101, 1, 1, "SPEEDING - 10% OVER"),
    (102, 1, 1, "NO LICENSE"),
    (103, 1, 1, "FAILED TO CONTROL SPEED"),
]

DAMAGE_COLS = ["crash_id", "damaged_property"]
DAMAGES = [(100, "NONE"), (101, "FENCE"), (101, "NO DAMAGE TO POLE"), (103, "NONE")]

ENDORSE_COLS = ["crash_id", "unit_nbr", "drvr_lic_endors_id"]
ENDORSE = [(100, 1, "NONE")]
RESTRICT_COLS = ["crash_id", "unit_nbr", "drvr_lic_restric_id"]
RESTRICT = [(100, 1, "NONE")]

TABLES = {
    "units": (UNITS_COLS, UNITS),
    "primary_person": (PERSON_COLS, PERSONS),
    "charges": (CHARGE_COLS, CHARGES),
    "damages": (DAMAGE_COLS, DAMAGES),
    "endorse": (ENDORSE_COLS, ENDORSE),
    "restrict": (RESTRICT_COLS, RESTRICT),
}

# Answers worked out by hand.
EXPECTED = {
    "q1": [(100, 3)],
    "q2_count": [(2,)],
    "q3": [("FORD", 1), ("TOYOTA", 1)],
    "q4_count": [(2,)],
    "q5": [("Texas", 2)],
    "q6": [("TOYOTA", 3), ("HONDA", 2), ("DODGE", 0)],
    "q7": [("MOTORCYCLE", "BLACK", 1), ("PASSENGER CAR, 2-DOOR", "HISPANIC", 1),
           ("PASSENGER CAR, 4-DOOR", "WHITE", 1), ("PICKUP", "WHITE", 1), ("POLICE MOTORCYCLE", "WHITE", 1)],
    "q8": [("78521", 1), ("90001", 1)],
    "q9_count": [(2,)],
    "q10": [("FORD", 2), ("HONDA", 1)],
}


def write_csv(folder, name, upper_header=True):
    """Write one fixture table as a CSV file with a header line; returns its path."""
    import csv
    import os
    cols, data = TABLES[name]
    path = os.path.join(folder, f"{name}.csv")
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow([c.upper() if upper_header else c for c in cols])
        for r in data:
            w.writerow(["" if v is None else v for v in r])
    return path
