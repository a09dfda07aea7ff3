"""Rows to sentences. The sentence patterns are fixed values and stand in full below."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole(name: str) -> Column:
    """Number cut to its whole part, as text."""
    return F.col(name).cast("double").cast("long").cast("string")


def sentence(*parts: Column | str) -> Column:
    """Concatenation in which plain strings are literal text."""
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def member_sentence(platform: str = "the platform") -> Column:
    """Description of a new member from its onboarding and early activity columns."""
    c = F.col
    registered = F.coalesce(c("company_is_registered") == 1, F.lit(False))
    # Wording of the member sentence.
    kind = F.when(registered, sentence("the account is of type ", c("company_type"), " and registered with the ", c("company_icc"), " industry classification. ")) \
        .otherwise(sentence("the account is of type ", c("company_type"), " and is not registered. "))
    age = sentence("The age of the applicant at onboarding is ", whole("applicant_age_at_completion"), " years, and the age of the business is ",
                   F.coalesce(sentence(whole("company_age_at_timestamp"), " months. "), F.lit("unknown. ")))
    keyword = F.when(c("is_restricted_keyword_present") == 1,
                     "It has high risk of fraudulent activity due to the presence of restricted keywords in its trading name; ") \
        .otherwise("has low or medium risk of fraudulent activity due to the absence of restricted keywords in its trading name; ")
    first_txn = F.coalesce(sentence("has done its first transaction after ", whole("days_to_transact"), " days since approval; "),
                           F.lit("has not done its first transaction till now since approval; "))
    expiry = sentence("valid for the next ", F.coalesce(whole("applicant_years_to_id_expiry"), F.lit("unknown")), " years and ")
    domain = F.when(c("applicant_email_domain") == "other", "other than standard").otherwise(c("applicant_email_domain"))
    return F.trim(sentence(
        "The member segment is '", F.when(c("is_ftt") > 0, f"First Transaction to {platform}").otherwise(f"New to {platform}"), "'; ",
        kind, age, keyword, first_txn,
        "has taken ", whole("days_to_approval"), " days to get approved after completing the onboarding event; ",
        "has completed ", whole("days_on_books"), " days on books since approval; ",
        "and ", whole("days_remaining_as_ntt_ftt"), " days are remaining to become a tenured member. ",
        "The email contains ", F.when(c("applicant_email_numeric") == 0, "no").otherwise("some"), " numeric characters with a domain that is ", domain,
        " and uses the ", c("applicant_device_type"), " operating system on a mobile device. ",
        "The proof of identification is a ", F.lower("applicant_id_type"), " issued by the ", c("applicant_idcountry_issue"), " that is ", expiry,
        "has been residing at the ", c("applicant_postcode"), " outward code. ",
        "The number of fast payment beneficiaries added is ", whole("fastpmt_beneficiaries"),
        ", the number of fast payment benefactors added is ", whole("fastpmt_benefactors"),
        " and, the number of direct debit beneficiaries added is ", whole("ddebit_beneficiaries"), ". ",
        "The average value of deposits made by the member is ", whole("avg_deposit"), " pounds."))


def payment_context(platform: str = "platform") -> Column:
    """First part of the payment sentence, from raw columns."""
    c = F.col
    # Wording of the payment sentence, first part.
    registered = F.when(F.coalesce(c("is_registered") == 1, F.lit(False)),
                        sentence("This member account is registered with ", c("industry_classification"), " industry classification, ")) \
        .otherwise("This member account is not registered, ")
    payees = F.coalesce(sentence("has ", whole("number_of_accounts_with_same_payee"), f" {platform} accounts with the same payee, "),
                        F.lit(f"has no {platform} accounts with the same payee, "))
    return sentence(registered, payees)


def payment_facts() -> Column:
    """Second part of the payment sentence, from derived columns."""
    # Wording of the payment sentence, second part.
    return sentence(
        "had done a transaction of ", whole("requested_payment_value"), " value in the first ", whole("hours_since_confirmation_of_payee"),
        " hours after payee addition. ",
        "The maximum of withdrawals done earlier to the payee in the last 60 days is ", whole("rolling_max_of_withdrawals_to_counter_party_60d"), ". ",
        "Also, the overall number of withdrawals over a high threshold in the last 60 days is ", whole("number_of_withdrawals_over_threshold_60d"), ". ",
        "Ratio of payments outside of the business in the last 60 days is ", whole("ratio_pmts_outside_business_60d"), ". ",
        "The average of deposits done earlier from the payee in the last 60 days is ", whole("rolling_mean_of_deposits_from_counter_party_60d"), ". ",
        "The number of high outgoing fast payments on the member account in the last 60 days is ", whole("number_of_high_outgoing_fastpayments_on_account_60d"), " ",
        "and total sum of withdrawals on the member account in the last 2 hours is ", whole("rolling_sum_of_withdrawals_on_account_2h"))


def payment_sentence(platform: str = "platform") -> Column:
    return F.concat(payment_context(platform), payment_facts())
