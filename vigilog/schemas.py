"""Explicit schemas, so that no job has to read the data twice to infer one."""

from __future__ import annotations

_ISSUER = (
    "type string, principalId string, arn string, accountId string, userName string"
)
_SESSION = (
    f"sessionIssuer struct<{_ISSUER}>, webIdFederationData string, "
    "attributes struct<creationDate string, mfaAuthenticated string>, "
    "sourceIdentity string, ec2RoleDelivery string, assumedRoot string"
)

# The public record of an audit event. Members that differ from service
# to service are kept as their JSON text.
_EVENT = f"""
    eventVersion string, eventID string, eventType string, eventTime string,
    eventSource string, eventName string, awsRegion string,
    sourceIPAddress string, userAgent string, recipientAccountId string,
    errorCode string, errorMessage string,
    userIdentity struct<
        type string, principalId string, arn string, accountId string,
        accessKeyId string, userName string, invokedBy string,
        identityProvider string, credentialId string, inScopeOf string, onBehalfOf string,
        sessionContext struct<{_SESSION}>>,
    requestParameters string, responseElements string,
    resources array<struct<arn string, accountId string, type string>>,
    requestID string, sharedEventID string, apiVersion string, additionalEventData string,
    readOnly string, managementEvent string, eventCategory string, serviceEventDetails string,
    vpcEndpointId string, vpcEndpointAccountId string, insightDetails string, addendum string,
    sessionCredentialFromConsole string, eventContext string, edgeDeviceDetails string,
    tlsDetails struct<tlsVersion string, cipherSuite string, clientProvidedHostHeader string>
"""
AUDIT_EVENT = " ".join(_EVENT.split())

# The access-log columns.
ACCESS_LOG_COLUMNS = ["bucketOwner", "bucket", "date", "ip", "requester", "operation", "key"]
ACCESS_LOG = ", ".join(f"{c} string" for c in ACCESS_LOG_COLUMNS)

REJECTS = "source string, line string, reason string"
OBSERVED = "field string, value string, is_new boolean"
PROFILE = "value string, first_batch bigint, profiler string"
ALERTS = (
    "profiler string, kind string, n_new bigint, n_current bigint, "
    "n_profile bigint, n_intersection bigint"
)
ALERT_MESSAGES = (
    "profiler string, kind string, address string, part bigint, parts bigint, "
    "subject string, body string"
)
STATUS = (
    "profiler string, field string, alert_count bigint, messages bigint, "
    "update_count bigint, profile_size bigint, profile_base bigint, line string"
)
EXIT_NODES = "ip string, hi bigint, lo bigint, retrieved_at timestamp"
LISTS = "list string, entries bigint, retrieved_at timestamp, reason string"
GEO_BLOCKS = "plen int, hi bigint, lo bigint, city string, country string"
